"""What goes out: reads by sample, reads that no sample claims, and tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import check_name


def write_samples(assigned: DataFrame, path: str, declared: list[str]) -> DataFrame:
    """Reads of each sample in a folder of its own, in order of src_index; (sample_id, reads) of all declared samples, with 0 for those without reads.

    Rows of a sheet may share a sample. A sample without reads has no folder; ``read_sample`` finds it empty.
    """
    for name in declared:
        check_name(name)
    kept = assigned.filter(F.col("status") == "assigned").withColumn("sample_id", F.col("sample"))
    order = ["src_index"] if "src_index" in assigned.columns else []
    placed = kept.repartitionByRange("sample_id", *order).sortWithinPartitions("sample_id", *order) if order else kept.repartition("sample_id")
    placed.write.partitionBy("sample_id").parquet(path)
    spark = assigned.sparkSession
    names = spark.createDataFrame([(n,) for n in sorted(set(declared))], "sample_id string")
    spark.createDataFrame([(json.dumps(sorted(set(declared))),)], "samples string").coalesce(1).write.text(f"{path}/_samples")
    counted = spark.read.schema(placed.schema).parquet(path).groupBy("sample_id").agg(F.count("*").alias("reads"))
    return names.join(counted, "sample_id", "left").select("sample_id", F.coalesce("reads", F.lit(0)).alias("reads"))


def declared_samples(spark: SparkSession, path: str) -> list[str]:
    return json.loads(spark.read.text(f"{path}/_samples").first().value)


def read_sample(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """The reads of one sample; without a name the folder must hold one sample only."""
    names = declared_samples(spark, path)
    if sample is None:
        if len(names) != 1:
            raise ValueError(f"{path} holds {len(names)} samples, {', '.join(names)}: name one")
        sample = names[0]
    if sample not in names:
        raise ValueError(f"{path} has no sample {sample!r}, only {', '.join(names)}")
    return spark.read.parquet(path).withColumn("sample_id", F.col("sample_id").cast("string")).filter(F.col("sample_id") == sample)


def write_unmatched(assigned: DataFrame, path: str) -> None:
    """Reads that no sample got, with why."""
    assigned.filter(F.col("status") != "assigned").drop("sample", "match").write.parquet(path)


def write_table(table: DataFrame, path: str, order: list[str], as_json: bool = False) -> None:
    """A small table in one file: TAB-separated with a header, or a JSON object a line."""
    one = table.orderBy(*order).coalesce(1).write
    one.json(path) if as_json else one.option("sep", "\t").option("header", True).csv(path)
