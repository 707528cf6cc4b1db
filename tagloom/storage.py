"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is unset, a local master gets a temporary folder and a
    cluster its warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and "cluster" not in master:
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        return _local[app]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local one")
    return warehouse


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tagloom-{name}-{uuid.uuid4().hex}"


#: Shuffle files go as soon as what reads them is written, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that are texts or sets fill a batch by their bytes before their number does.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written within leaves no shuffle files behind."""
    return _set(spark, CLEANUP, "true")


def narrow(spark: SparkSession) -> AbstractContextManager[None]:
    """Batches that go to Python within are ``BATCH_BYTES`` large or little more; a task holds a few at once, outside the heap and in Python."""
    return _set(spark, BATCH, str(BATCH_BYTES))


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` writes within are deleted at the end, unless it was to keep them: nothing may read them later."""
    outer, paths = _passing.get(), []
    _passing.set(paths)
    try:
        yield
    finally:
        _passing.set(outer)
        discard(spark, *paths)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage; the files outlive any executor. With ``keep``, they outlive ``passing``.
    """
    path = scratch(df.sparkSession, name)
    if not keep and (paths := _passing.get()) is not None:
        paths.append(path)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
