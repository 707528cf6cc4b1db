"""Barcoded reads derived from the order lines: one order is a molecule, one line a read.

Barcode and payload errors are put in by rule, and the true barcode is kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
RANK_WIDTH = 4096


def with_rank(df: DataFrame, first: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``keys``, whose leading column is the number ``first``.

    Rows are ranked within ranges of ``first``, ranges within their thousands, and
    only these are summed up in one task, so no single task sees all rows or ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(first) / RANK_WIDTH))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_group", F.floor(F.col("_range") / RANK_WIDTH))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_group").agg(F.sum("n").alias("n")).select("_group", F.coalesce(F.sum("n").over(earlier.partitionBy(F.lit(0)).orderBy("_group")), F.lit(0)).alias("_g"))
    inner = F.coalesce(F.sum("n").over(earlier.partitionBy("_group").orderBy("_range")), F.lit(0))
    offsets = sizes.withColumn("_r", inner).join(groups, "_group").select("_range", (F.col("_g") + F.col("_r")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_in", inside).join(offsets, "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")


def _letters(prefix: str, number: Column, width: int) -> Column:
    """The first ``width`` letters of the number's hash."""
    return F.translate(F.substring(F.md5(F.concat(F.lit(prefix), number.cast("string"))), 1, width), "0123456789abcdef", "ACGTACGTACGTACGT")


def _listed(prefix: str, number: Column, period: int, width: int) -> Column:
    """``_letters`` of ``number`` % ``period``, from a list of them all: a look-up instead of a hash a row. The rest of a negative number is negative."""
    to = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    known = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:width].translate(to) for i in range(1 - period, period)]
    return F.get(F.split(F.lit(",".join(known)), ","), (number % period + period - 1).cast("int"))


def _swapped(s: Column, at: Column, to: str) -> Column:
    return F.concat(F.substring(s, F.lit(1), at), F.translate(F.substring(s, at + 1, F.lit(1)), "ACGT", to), F.substring(s, at + 2, F.length(s)))


def reads(spark: SparkSession, sf_dir: str, index: bool = True) -> DataFrame:
    """(src_index, sample_id, cell, umi, umi_true, umi_qual, seq, qual); without ``index`` no src_index, which takes a shuffle to number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEY, "l_quantity")
    lines = with_rank(lines, "l_orderkey", KEY, "src_index") if index else lines
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    base = lines.select(
        *["src_index"] * index,
        F.concat(F.lit("S"), (order % 4 + 1).cast("string")).alias("sample_id"),
        _listed("c", order, 97, 16).alias("cell"),
        _letters("u", order, 12).alias("umi_true"),
        ((part * 31 + supp) % 17 == 0).alias("ue"),
        (part % 12).cast("int").alias("up"),
        ((part * 7 + supp) % 11 == 0).alias("se"),
        (supp % 32).cast("int").alias("sp"),
        (20 + F.col("l_quantity").cast("int") % 18).cast("int").alias("q0"),
        _listed("p", order, 500, 32).alias("s0"),
    )
    q = F.char(F.lit(33) + F.col("q0"))
    flat = F.expr("repeat(char(33 + q0), 12)")
    return base.select(
        *["src_index"] * index, "sample_id", "cell",
        F.when(~F.col("ue"), F.col("umi_true")).otherwise(_swapped(F.col("umi_true"), F.col("up"), "CGTA")).alias("umi"),
        "umi_true",
        F.concat(F.substring(flat, F.lit(1), F.col("up")), F.when(~F.col("ue"), q).otherwise(F.lit(")")), F.substring(flat, F.col("up") + 2, F.lit(12))).alias("umi_qual"),
        F.when(~F.col("se"), F.col("s0")).otherwise(_swapped(F.col("s0"), F.col("sp"), "GTAC")).alias("seq"),
        F.expr("repeat(char(33 + q0), 32)").alias("qual"),
    )


#: The same in DuckDB.
READS_SQL = """
SELECT src_index, sample_id, cell,
       CASE WHEN ue = 0 THEN umi_true ELSE concat(substr(umi_true, 1, up), translate(substr(umi_true, up + 1, 1), 'ACGT', 'CGTA'), substr(umi_true, up + 2)) END AS umi,
       umi_true,
       concat(substr(repeat(chr(33 + q0), 12), 1, up), CASE WHEN ue = 0 THEN chr(33 + q0) ELSE chr(41) END, substr(repeat(chr(33 + q0), 12), up + 2)) AS umi_qual,
       CASE WHEN se = 0 THEN s0 ELSE concat(substr(s0, 1, sp), translate(substr(s0, sp + 1, 1), 'ACGT', 'GTAC'), substr(s0, sp + 2)) END AS seq,
       repeat(chr(33 + q0), 32) AS qual
FROM (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS BIGINT) AS src_index,
         concat('S', CAST(l_orderkey % 4 + 1 AS VARCHAR)) AS sample_id,
         substr(translate(md5(concat('c', CAST(l_orderkey % 97 AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS cell,
         substr(translate(md5(concat('u', CAST(l_orderkey AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS umi_true,
         CASE WHEN (l_partkey * 31 + l_suppkey) % 17 = 0 THEN 1 ELSE 0 END AS ue,
         CAST(l_partkey % 12 AS INT) AS up,
         CASE WHEN (l_partkey * 7 + l_suppkey) % 11 = 0 THEN 1 ELSE 0 END AS se,
         CAST(l_suppkey % 32 AS INT) AS sp,
         CAST(20 + CAST(l_quantity AS INT) % 18 AS INT) AS q0,
         translate(md5(concat('p', CAST(l_orderkey % 500 AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s0
  FROM lineitem
) t
"""
