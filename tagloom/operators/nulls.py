"""What chance alone gives: the linkage of reads whose minority bases are dealt anew.

The curveball chain (Strona et al., 2014) keeps both margins of a molecule's binary
reads x columns matrix: two reads at a time trade the columns that only one of them has.
Keeping a read's number of minority bases matters, as a bad read is
minor in many places at once and looks just like a linked part.

Chains run inside the pass that sorts reads by molecule, many side by side in one array: a
read's row is a word of bits. Random numbers come from a counter hashed with the molecule's
reads and the seed, so the result does not depend on how molecules are dealt to tasks.
Scores of all molecules are merged as a histogram; nothing larger than its bins meets
in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .consensus import by_molecule
from .split import MAX_COLUMNS, MIN_MINOR, best_pair, minor_matrices, shared

MIN_READS, MAX_READS = 10, 200  # of molecules that have a null: fewer say nothing, more take long
REPEATS = 20
TRADES = 20  # a read
TARGETS = (0.05, 0.01, 0.001)  # shares of false calls
BINS = 1000  # of the histogram, a unit of score
TOGETHER = 1 << 12  # chains side by side


def _hashed(x: np.ndarray) -> np.ndarray:
    """splitmix64's mixing."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def curveball(rows: np.ndarray, columns: int, trades: int, seeds: np.ndarray) -> np.ndarray:
    """Chains x reads of bit words after so many trades; a seed a chain. Margins stay as they are."""
    rows = rows.copy()
    chains, n = rows.shape
    if n < 2 or not chains:
        return rows
    at, lanes = np.arange(chains), np.arange(columns + 2, dtype=np.uint64)
    ones = np.ones((), rows.dtype) << np.arange(columns, dtype=rows.dtype)
    for step in range(trades):
        draws = _hashed(seeds[:, None] + (np.uint64(step * (columns + 2)) + lanes) * np.uint64(0x9E3779B97F4A7C15))
        i, j = ((draws[:, c] % np.uint64(n)).astype(np.int64) for c in (0, 1))
        a, b = rows[at, i], rows[at, j]
        pool, mine = a ^ b, np.bitwise_count(a & ~b)
        in_pool = (pool[:, None] & ones) != 0
        order = np.argsort(np.where(in_pool, draws[:, 2:] >> np.uint64(1), np.uint64(2**64 - 1)), axis=1)
        dealt = np.where(np.arange(columns) < mine[:, None], ones[order], 0).sum(axis=1, dtype=rows.dtype)
        trade = (i != j) & (mine > 0) & (mine < np.bitwise_count(pool))
        rows[at[trade], i[trade]] = ((a & b) | dealt)[trade]
        rows[at[trade], j[trade]] = ((a & b) | (pool & ~dealt))[trade]
    return rows


def _words(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << np.arange(bits.shape[1], dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def null_scores(matrices: list[np.ndarray], seeds: list[int], repeats: int, trades: int = TRADES) -> list[list[float]]:
    """Linkage scores of ``repeats`` matrices with the margins of each of ``matrices``. Those of one shape go side by side."""
    out: list[list[float]] = [[] for _ in matrices]
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, bits in enumerate(matrices):
        shapes.setdefault(bits.shape, []).append(i)
    for (n, k), some in shapes.items():
        chains = [(i, r) for i in some for r in range(repeats)]
        for at in range(0, len(chains), TOGETHER):
            part = chains[at : at + TOGETHER]
            start = _hashed(np.array([(seeds[i] + r) % 2**64 for i, r in part], np.uint64))
            rows = curveball(np.stack([_words(matrices[i]) for i, _ in part]), k, trades * n, start)
            bits = ((rows[:, :, None] >> np.arange(k, dtype=np.uint32)) & 1).astype(np.float32)
            for (i, _), both in zip(part, np.matmul(bits.transpose(0, 2, 1), bits).astype(np.int64)):
                out[i].append(best_pair(both, n)[0])
    return out


def _seed(seqs: list[bytes], seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"\n".join(seqs), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "big")


def linkage_scores(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), repeats: int = REPEATS, seed: int = 1, min_reads: int = MIN_READS, max_reads: int = MAX_READS, min_minor: int = MIN_MINOR, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """(keys, observed, null): each molecule's linkage, and ``repeats`` of its null.

    Molecules of ``min_reads`` to ``max_reads`` reads with two minor columns or more take part.
    """
    n = reads.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n").between(min_reads, max_reads)).drop("_n")
    some = reads.join(n, list(keys), "left_semi")

    def run(seqs, quals, starts):
        found = [(g, bits) for g, at, _, _, bits in minor_matrices(seqs, starts, min_reads, min_minor, max_columns) if len(at) > 1]
        observed = [best_pair(shared(bits), len(bits))[0] for _, bits in found]
        seeds = [_seed(seqs[starts[g] : starts[g] + len(bits)], seed) for g, bits in found]
        null = null_scores([bits for _, bits in found], seeds, repeats)
        return [g for g, _ in found], [pa.array(observed, pa.float64()), pa.array(null, pa.list_(pa.float64()))]

    return by_molecule(some, keys, run, "observed double, null array<double>")


def linkage_null(scores: DataFrame, by: str = "sample_id", targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(by, target, molecules, randomisations, threshold, low, high, called, fraction) of ``linkage_scores``.

    ``threshold`` is the score that a share ``target`` of the null lies above, by nearest rank,
    ``low`` and ``high`` the scores 1.96 deviations of that rank beside it; ``called`` molecules are above it.
    """
    bins = scores.select(by, F.explode("null").alias("s")).groupBy(by, F.round(F.col("s") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    each = Window.partitionBy(by)
    ranked = bins.select(by, "bin", F.sum("c").over(each.orderBy("bin")).alias("to"), F.sum("c").over(each).alias("n")).select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    middle, aside = F.bround((1 - F.col("target")) * (F.col("n") - 1)) + 1, 1.96 * F.sqrt(F.col("n") * F.col("target") * (1 - F.col("target")))

    def at(rank):
        return F.min(F.when(F.col("to") >= F.least(F.greatest(rank, F.lit(1)), F.col("n")), F.col("bin"))) / BINS

    null = ranked.groupBy(by, "target").agg(F.first("n").alias("randomisations"), at(middle).alias("threshold"), at(F.floor(middle - aside)).alias("low"), at(F.ceil(middle + aside)).alias("high"))
    seen = scores.select(by, "observed").join(null, by).groupBy(by, "target", "randomisations", "threshold", "low", "high")
    out = seen.agg(F.count("*").alias("molecules"), F.count_if(F.round(F.col("observed") * BINS) > F.round(F.col("threshold") * BINS)).alias("called"))
    return out.select(by, "target", "molecules", "randomisations", "threshold", "low", "high", "called", (F.col("called") / F.col("molecules")).alias("fraction"))
