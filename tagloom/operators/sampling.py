"""Taking part of the reads: whole molecules by a hash of their key, or the first so many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

PARTS = 10_000


def packed_hash(packed: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on unsigned 64-bit integers; its constants are fixed values."""
    with np.errstate(over="ignore"):
        z = packed + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@F.pandas_udf(LongType())
def part_of(barcodes: pd.Series) -> pd.Series:
    """Which of ``PARTS`` equal parts a barcode of up to 32 bases falls in."""
    code = np.zeros(256, np.uint64)
    code[list(b"CGT")] = 1, 2, 3
    letters = np.array([b[:32].ljust(32, "A") for b in barcodes], "S32").view(np.uint8).reshape(-1, 32)
    packed = (code[letters] << np.arange(62, -2, -2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return pd.Series((packed_hash(packed) % np.uint64(PARTS)).astype(np.int64))


def subsample(reads: DataFrame, per_10k: int, key: Column | str | None = None) -> DataFrame:
    """Reads of the molecules in the first ``per_10k`` parts: by cell where there is one, else by barcode.

    A molecule's reads stay together, whatever the partitioning.
    """
    if not 1 <= per_10k <= PARTS:
        raise ValueError(f"per_10k must be 1 to {PARTS}")
    if key is None:
        key = F.when(F.length(F.coalesce("cell", F.lit(""))) > 0, F.col("cell")).otherwise(F.col("umi")) if "cell" in reads.columns else F.col("umi")
    key = F.col(key) if isinstance(key, str) else key
    return reads.filter(F.length(key) > 0).filter(part_of(key) < per_10k)


def kept_statistics(reads: DataFrame, key: str = "umi", examples: int = 5) -> DataFrame:
    """(barcodes, reads, median_reads, max_reads, examples): reads per kept barcode, the upper median, and the first barcodes in key order."""
    counts = reads.filter(F.length(key) > 0).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    spectrum = counts.groupBy("n").agg(F.count("*").alias("m"))
    down = Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = spectrum.select("n", "m", F.sum("m").over(down).alias("to"), F.sum("m").over(Window.partitionBy(F.lit(0))).alias("all"))  # a row per distinct count
    sums = upto.agg(F.max("all").alias("barcodes"), F.sum(F.col("n") * F.col("m")).alias("reads"), F.min(F.when(F.col("to") > F.floor(F.col("all") / 2), F.col("n"))).alias("median_reads"), F.max("n").alias("max_reads"))
    first = counts.select("key").orderBy("key").limit(examples).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return sums.withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").drop("_one")


def in_order(reads: DataFrame) -> DataFrame:
    """``reads`` with place, from 0 in the order of cell, barcode and src_index: ranks within a cell's barcode prefixes, after the reads of those before."""
    rows = reads.withColumn("_p", F.substring("umi", 1, 3))
    sizes = rows.groupBy("cell", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.groupBy("cell").agg(F.sum("_n").alias("_n")).select("cell", F.coalesce(F.sum("_n").over(earlier.partitionBy(F.lit(0)).orderBy("cell")), F.lit(0)).alias("_c"))  # a row per cell
    inner = F.coalesce(F.sum("_n").over(earlier.partitionBy("cell").orderBy("_p")), F.lit(0))
    offsets = sizes.withColumn("_b", inner).join(cells, "cell").select("cell", "_p", (F.col("_b") + F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("cell", "_p").orderBy("umi", "src_index")) - 1
    return rows.withColumn("_in", inside).join(offsets, ["cell", "_p"]).withColumn("place", (F.col("_before") + F.col("_in")).cast("long")).drop("_p", "_in", "_before")


def hash_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """A sample of n rows: those with the least hashes of their keys, so the same whatever the partitioning."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(n)


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads; the filter reaches the scan."""
    return reads.filter(F.col("src_index") < n)


def first_barcodes(reads: DataFrame, n: int, key: str = "umi") -> DataFrame:
    """Reads before the first one that carries the (n+1)-th distinct barcode."""
    seen = reads.groupBy(key).agg(F.min("src_index").alias("first"))
    cut = seen.orderBy("first").limit(n + 1).agg(F.when(F.count("*") > n, F.max("first")).alias("cut")).first().cut
    return reads if cut is None else reads.filter(F.col("src_index") < cut)
