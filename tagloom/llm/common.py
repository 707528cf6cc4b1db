"""What the operators share: written intermediate tables, folds, objects for the executors."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, narrow, passing, scratch, shared_dir, tidy, written

__all__ = ["discard", "fold", "narrow", "passing", "scratch", "shared_dir", "shipped", "table", "tidy", "unpacked", "written"]


def fold(key: str | Column, folds: int, which: int) -> Column:
    """True for rows whose crc32 of the key's text leaves ``which`` modulo ``folds``; a null key gives false."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == which, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, thing: Any) -> Broadcast:
    """``thing`` broadcast with the code of its class; of a bounded size, which the caller checks."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def unpacked(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)
