"""Column functions on bases, qualities, tags and read names. All but ``planes_compared`` stay inside the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
PHRED_OFFSET = 33
PHRED_MAX = 60


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    """Other letters become N; case is kept."""
    return F.reverse(F.translate(F.regexp_replace(_c(seq), "[^ACGTacgtNn]", "N"), "ACGTacgt", "TGCAtgca"))


def folded(seq: Column | str) -> Column:
    """A barcode as it is counted: upper case, everything else than C, G, T an A."""
    upper = F.upper(_c(seq))
    return F.when(F.translate(upper, "ACGT", "") == "", upper).otherwise(F.regexp_replace(upper, "[^ACGT]", "A"))


def phred(quality: Column | str, position: Column | int) -> Column:
    """Phred value at a 1-based position, within 0..60."""
    position = F.lit(position) if isinstance(position, int) else position
    return F.greatest(F.least(F.ascii(_c(quality).substr(position, F.lit(1))) - PHRED_OFFSET, F.lit(PHRED_MAX)), F.lit(0))


def error_of(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def phreds(quality: Column | str) -> Column:
    """All Phred values of a quality string as an array."""
    q = _c(quality)
    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: phred(q, i))).otherwise(F.array().cast("array<int>"))


def min_phred(quality: Column | str) -> Column:
    return F.array_min(phreds(quality))


def size_bin(n: Column | str, cap: int | None = None) -> Column:
    """floor(log2 n), exactly, for n >= 1."""
    b = F.length(F.bin(_c(n))) - 1
    return F.least(b, F.lit(cap)) if cap is not None else b


def tag(comment: Column | str, name: str) -> Column:
    """Value of a TAB-separated NAME:Z:value; empty if absent."""
    return F.regexp_extract(_c(comment), rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)


def tags(**values: Column) -> Column:
    """NAME:Z:value joined by TABs; empty and null values are left out."""
    return F.concat_ws("\t", *[F.when(F.length(v) > 0, F.concat(F.lit(f"{k}:Z:"), v)) for k, v in values.items()])


def index_pair(comment: Column | str) -> Column:
    """struct(i7, i5) from the text after the last colon; null if that holds a TAB or there is none."""
    last = F.substring_index(_c(comment), ":", -1)
    parts = F.split(last, r"\+")
    usable = F.contains(_c(comment), F.lit(":")) & ~F.contains(last, F.lit("\t")) & (F.length(last) > 0)
    return F.when(usable, F.struct(parts[0].alias("i7"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("i5")))


def lane_tile(name: Column | str) -> Column:
    """struct(lane, tile): fields 4 and 5 of seven or more, 2 and 3 of exactly five, else null."""
    f = F.split(_c(name), ":")
    long_, short = F.size(f) >= 7, F.size(f) == 5

    def number(at_long: int, at_short: int) -> Column:
        return F.when(long_, F.get(f, F.lit(at_long))).when(short, F.get(f, F.lit(at_short))).try_cast("int")

    return F.when(long_ | short, F.struct(number(3, 1).alias("lane"), number(4, 2).alias("tile")))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ where both strings have one and neither is N."""
    a, b = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.when((x != y) & (x != "N") & (y != "N"), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def comparable(a: Column | str, b: Column | str) -> Column:
    """Places where both strings have a base other than N."""
    a, b = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.when((x != "N") & (y != "N"), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


PLANES = 32  # places in a bit plane


def plain(s: Column | str) -> Column:
    """Whether ``planes`` can stand for the string."""
    return _c(s).rlike(f"^[ACGTN]{{0,{PLANES}}}$")


def planes(s: Column | str) -> Column:
    """struct(high, low, none): two bits of each base and one for N or the end, as longs, from which pairs are compared in a few instructions."""
    padded = F.rpad(_c(s), PLANES, "N")
    return F.struct(*(F.conv(F.translate(padded, "ACGTN", to), 2, 10).cast("long").alias(name) for name, to in (("high", "00110"), ("low", "01010"), ("none", "00001"))))


def planes_comparable(a: str, b: str) -> Column:
    """``comparable`` of strings given as ``planes``."""
    return PLANES - F.bit_count(F.col(f"{a}.none").bitwiseOR(F.col(f"{b}.none")))


def planes_hamming(a: str, b: str) -> Column:
    """``hamming`` of strings given as ``planes``."""
    differ = F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")).bitwiseOR(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")))
    return F.bit_count(differ.bitwiseAND(F.bitwise_not(F.col(f"{a}.none").bitwiseOR(F.col(f"{b}.none")))))


def planes_compared(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``planes_comparable`` and ``planes_hamming`` of arrays, within a task."""
    none = a["none"] | b["none"]
    differ = ((a["high"] ^ b["high"]) | (a["low"] ^ b["low"])) & ~none
    return PLANES - np.bitwise_count(none).astype(np.int64), np.bitwise_count(differ).astype(np.int64)


def genome_equivalents(nanograms: Column | str, picograms_per_genome: float = 3.3) -> Column:
    return _c(nanograms) * F.lit(1000.0) / F.lit(picograms_per_genome)


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X >= k) for a Poisson variable."""
    below = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
        F.struct(F.lit(0.0).alias("sum"), F.exp(-mean).alias("term")),
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * mean / (i + 1)).alias("term")),
        lambda s: s["sum"],
    )
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) - below, F.lit(0.0)))


def poisson_interval(count: Column) -> tuple[Column, Column]:
    """95 % limits of a Poisson mean by Wilson and Hilferty's cube."""
    z = F.lit(1.959963984540054)

    def cube(n: Column, sign: int) -> Column:
        return n * F.pow(1 - 1 / (9 * n) + sign * z / (3 * F.sqrt(n)), F.lit(3.0))

    low = F.when(count <= 0, F.lit(0.0)).otherwise(F.greatest(cube(F.greatest(count, F.lit(1)).cast("double"), -1), F.lit(0.0)))
    return low, cube(count.cast("double") + 1, 1)
