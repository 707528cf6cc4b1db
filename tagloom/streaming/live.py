"""Reads as they arrive: matching is stateless, barcode counts are kept up to date.

Correction and consensus need whole molecules and stay batch jobs; ``foreachBatch``
may run them on the counts. Counts have no event time, so their state grows with
the number of distinct barcodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.barcodes import barcode_counts
from ..operators.match import match


def live_matches(reads: DataFrame, layout: str, max_offset: int = 0) -> DataFrame:
    """A stream of reads with their match."""
    return match(reads, layout, max_offset).filter("match.found")


def live_counts(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts per barcode: with every batch, the barcodes it changed go to a folder of their own in ``path``."""

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # a batch that is done again replaces itself

    return barcode_counts(reads).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, key, cnt): each barcode's latest count in the folder that ``live_counts`` writes."""
    return spark.read.parquet(path).groupBy("sample_id", "key").agg(F.max_by("cnt", "batch").alias("cnt"))
