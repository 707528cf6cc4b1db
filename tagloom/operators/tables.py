"""Tables over corrected barcodes: spectra, size bins, residual errors, rank curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import comparable, hamming, plain, planes, planes_compared, size_bin
from .neighbours import Side, neighbour_pairs

RANK_STEP = 1.05
RESIDUAL_RATIO = 20
CLONAL = 0.5
MIN_COMPARED = 8
MIN_PARENT_READS = 10


def _bounds(bin_: str = "_bin") -> list:
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bin_))
    return [low.alias("min_reads"), (low * 2 - 1).alias("max_reads")]


def size_spectrum(table: DataFrame) -> DataFrame:
    """(sample_id, size, log1p_size, molecules, reads) over surviving barcodes' corrected counts."""
    return table.filter("corrected > 0").groupBy("sample_id", F.col("corrected").alias("size")).agg(F.count("*").alias("molecules"), F.sum("corrected").alias("reads")).select("sample_id", "size", F.log1p(F.col("size").cast("double")).alias("log1p_size"), "molecules", "reads")


def size_bins(table: DataFrame) -> DataFrame:
    """(sample_id, min_reads, max_reads, barcodes, reads, merged, fraction_erroneous, molecules).

    Barcodes, reads and merged are by a barcode's own count, molecules by the corrected one.
    """
    own = table.groupBy("sample_id", size_bin("cnt").alias("_bin")).agg(F.count("*").alias("barcodes"), F.sum("cnt").alias("reads"), F.count_if(F.col("corrected") == 0).alias("merged"))
    kept = table.filter("corrected > 0").groupBy("sample_id", size_bin("corrected").alias("_bin")).agg(F.count("*").alias("molecules"))
    both = own.join(kept, ["sample_id", "_bin"], "full")
    n = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("barcodes", "reads", "merged", "molecules")}
    share = F.when(F.col("barcodes") > 0, F.col("merged") / F.col("barcodes")).otherwise(0.0).alias("fraction_erroneous")
    return both.select("sample_id", "_bin", *n.values()).select("sample_id", *_bounds(), "barcodes", "reads", "merged", share, "molecules")


def _suspects(a: Side, b: Side) -> np.ndarray:
    """Pairs in which b makes a suspect, by counts or by payloads as ``planes``."""
    compared, mismatched = planes_compared(a, b)
    alike = (a["clonality"] < CLONAL) & (compared >= MIN_COMPARED) & (mismatched * RESIDUAL_RATIO <= compared)
    return (b["cnt"] >= RESIDUAL_RATIO * a["cnt"]) | ((b["cnt"] >= a["cnt"]) & alike)


def residual_fdr(table: DataFrame, drafts: DataFrame | None = None, clonality: DataFrame | None = None) -> DataFrame:
    """(sample_id, min_reads, max_reads, molecules, suspected_residual, residual_fdr).

    A survivor is suspected if a surviving neighbour at distance one has twenty times its
    corrected reads or more. With ``drafts`` (sample_id, key, payload) and ``clonality``
    (sample_id, clonality) also if a neighbour of as many reads agrees in payload, in a
    sample where unrelated barcodes seldom do.
    """
    kept = table.filter("corrected > 0").select("sample_id", "key", F.col("corrected").alias("cnt"))
    larger = F.col("theirs") >= RESIDUAL_RATIO * F.col("mine")

    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.select("sample_id", F.col("a.key").alias("key"), F.col("a.cnt").alias("mine"), F.col("b.key").alias("other"), F.col("b.cnt").alias("theirs"))

    if drafts is None or clonality is None:
        pairs = sides(neighbour_pairs(kept, "cnt", keep=lambda a, b: b["cnt"] >= RESIDUAL_RATIO * a["cnt"]))
    elif drafts.filter(~plain("payload")).isEmpty():
        drawn = kept.join(drafts.select("sample_id", "key", planes("payload").alias("_p")), ["sample_id", "key"]).join(F.broadcast(clonality), "sample_id")  # a row per sample
        pairs = sides(neighbour_pairs(drawn.select("sample_id", "key", "cnt", "clonality", "_p.*"), "cnt", "clonality", "high", "low", "none", keep=_suspects))
        larger = F.lit(True)
    else:
        draft = drafts.select("sample_id", "key", "payload")
        pairs = sides(neighbour_pairs(kept, "cnt", keep=lambda a, b: b["cnt"] >= a["cnt"])).join(draft, ["sample_id", "key"]).join(draft.select("sample_id", F.col("key").alias("other"), F.col("payload").alias("_p")), ["sample_id", "other"]).join(F.broadcast(clonality), "sample_id")
        compared = comparable("payload", "_p")
        larger = larger | ((F.col("clonality") < CLONAL) & (compared >= MIN_COMPARED) & (hamming("payload", "_p") * RESIDUAL_RATIO <= compared))
    suspected = pairs.filter(larger).select("sample_id", "key").distinct().withColumn("_bad", F.lit(1))
    marked = kept.join(suspected, ["sample_id", "key"], "left").groupBy("sample_id", size_bin("cnt").alias("_bin")).agg(F.count("*").alias("molecules"), F.count("_bad").alias("suspected_residual"))
    return marked.select("sample_id", *_bounds(), "molecules", "suspected_residual", (F.col("suspected_residual") / F.col("molecules")).alias("residual_fdr"))


def size_threshold(residual: DataFrame, target: float = 0.05) -> DataFrame:
    """(sample_id, threshold, fdr_at_one): the smallest size whose bin has the target rate or less, null without any; reported, never applied."""
    good = F.when(F.col("residual_fdr") <= target, F.col("min_reads"))
    return residual.groupBy("sample_id").agg(F.min(good).alias("threshold"), F.coalesce(F.max(F.when(F.col("min_reads") == 1, F.col("residual_fdr"))), F.lit(0.0)).alias("fdr_at_one"))


def payload_entropy(barcodes: DataFrame) -> DataFrame:
    """(sample_id, min_reads, max_reads, payload_entropy_bits): by a barcode's own count, the mean entropy of its payload draft's columns with two bases or more."""
    places = barcodes.select("sample_id", size_bin("cnt").alias("_bin"), F.posexplode(F.split("payload", "")).alias("at", "base")).filter(F.col("base").isin("A", "C", "G", "T"))
    n = places.groupBy("sample_id", "_bin", "at", "base").agg(F.count("*").alias("n"))
    columns = n.groupBy("sample_id", "_bin", "at").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s")).filter(F.col("all") >= 2)
    out = columns.groupBy("sample_id", "_bin").agg(F.avg(F.log2("all") - F.col("s") / F.col("all")).alias("payload_entropy_bits"))
    return out.select("sample_id", *_bounds(), "payload_entropy_bits")


def error_at_depth(by_depth: DataFrame, length: int = 12) -> DataFrame:
    """(sample_id, error_from_children, error_at_depth, error_phred): reads of children per base of their parents' reads, of all and of parents of ten reads or more."""
    reads = F.col("parent_reads") * F.col("parents")
    deep = F.col("parent_reads") >= MIN_PARENT_READS
    sums = by_depth.groupBy("sample_id").agg(F.sum(reads).alias("a"), F.sum("child_reads").alias("b"), F.sum(F.when(deep, reads)).alias("c"), F.sum(F.when(deep, F.col("child_reads"))).alias("d"))
    at = F.when(F.col("c") > 0, F.col("d") / (F.col("c") * length))
    return sums.select("sample_id", F.when(F.col("a") > 0, F.col("b") / (F.col("a") * length)).otherwise(0.0).alias("error_from_children"), at.alias("error_at_depth"), F.when(at > 0, -10 * F.log10(at)).alias("error_phred"))


def errors_by_depth(table: DataFrame, chosen: DataFrame, length: int = 12) -> DataFrame:
    """(sample_id, parent_reads, parents, child_barcodes, child_reads, children_per_parent, error_from_variants, error_from_reads)."""
    roots = table.filter("corrected > 0").select("sample_id", "key", "cnt")
    children = table.select("sample_id", F.col("key").alias("child"), F.col("cnt").alias("c")).join(chosen.select("sample_id", "child", "parent"), ["sample_id", "child"])
    per_parent = children.groupBy("sample_id", F.col("parent").alias("key")).agg(F.count("*").alias("kids"), F.sum("c").alias("kid_reads"))
    joined = roots.join(per_parent, ["sample_id", "key"], "left").groupBy("sample_id", F.col("cnt").alias("parent_reads")).agg(F.count("*").alias("parents"), F.coalesce(F.sum("kids"), F.lit(0)).alias("child_barcodes"), F.coalesce(F.sum("kid_reads"), F.lit(0)).alias("child_reads"))
    per, reads = F.col("child_barcodes") / F.col("parents"), F.col("child_reads") / F.col("parents")
    whole = 3.0 * length
    return joined.select(
        "sample_id", "parent_reads", "parents", "child_barcodes", "child_reads", per.alias("children_per_parent"),
        F.when(per < whole, -3.0 / F.col("parent_reads") * F.log(1 - per / whole)).alias("error_from_variants"), (reads / (F.col("parent_reads") * length)).alias("error_from_reads"),
    )


def rank_grid(n: int) -> list[int]:
    """1, then each next rank or five per cent more, and n last."""
    out, at = [], 1
    while at <= n:
        out.append(at)
        at = max(at + 1, int(RANK_STEP * at))
    return out if not out or out[-1] == n else [*out, n]


def spaced_ranks(n: Column) -> Column:
    """``rank_grid`` as an expression: about 20 ranks per factor of e."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(900)),
        F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("ranks")),
        lambda s, _: F.when(s["at"] > n, s).otherwise(F.struct(F.greatest(s["at"] + 1, F.floor(F.round(s["at"] * 105) / 100)).cast("long").alias("at"), F.concat(s["ranks"], F.array(s["at"])).alias("ranks"))),
        lambda s: F.array_distinct(F.concat(s["ranks"], F.array(n))),
    )


def molecule_rank(table: DataFrame) -> DataFrame:
    """(sample_id, rank, reads, cumulative_reads, cumulative_fraction) at spaced ranks, largest molecules first.

    From the spectrum, whose rows are distinct sizes; molecules are never sorted.
    """
    spectrum = size_spectrum(table).select("sample_id", "size", "molecules", "reads")
    down = Window.partitionBy("sample_id").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sample_id")
    spectrum = spectrum.select("sample_id", "size", "molecules", F.sum("molecules").over(down).alias("to"), F.sum("reads").over(down).alias("reads_to"), F.sum("molecules").over(whole).alias("n"), F.sum("reads").over(whole).alias("total"))
    grids = spectrum.select("sample_id", "n").distinct().select("sample_id", F.explode(spaced_ranks(F.col("n"))).alias("rank"))
    hit = spectrum.join(grids, "sample_id").filter((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("molecules")))
    upto = F.col("reads_to") - (F.col("to") - F.col("rank")) * F.col("size")
    return hit.select("sample_id", "rank", F.col("size").alias("reads"), upto.alias("cumulative_reads"), (upto / F.col("total")).alias("cumulative_fraction"))
