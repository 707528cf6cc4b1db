"""FASTQ files of each sample, written by a Spark data source.

A task writes into a folder of its own attempt; when all tasks are done the driver moves the
files of those attempts that count to their places and drops the rest, so a task that failed or ran twice leaves
nothing behind and no read comes twice. Declared samples without reads get an empty file.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.layout import check_name
from .fastq import _located, read_fastq

PENDING = "_pending"
LEVEL = 1  # of gzip: fast


@dataclass
class Written(WriterCommitMessage):
    """The files of one attempt: (sample, path, reads)."""

    files: list[tuple[str, str, int]]


class SampleWriter(DataSourceArrowWriter):
    """Rows (sample, name, comment, seq, qual), those of a sample together, as ``<path>/<sample>/part-<task>.fastq[.gz]``."""

    def __init__(self, path: str, samples: list[str], compress: bool):
        self.path, self.samples, self.compress = path, samples, compress
        self.job = uuid.uuid4().hex

    def _suffix(self) -> str:
        return ".fastq.gz" if self.compress else ".fastq"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _located(self.path)
        folder = posixpath.join(root, PENDING, self.job, uuid.uuid4().hex)
        task, open_, found = TaskContext.get().partitionId(), None, []
        counts: dict[str, int] = {}
        try:
            for batch in iterator:
                rows = zip(*(batch.column(c).to_pylist() for c in ("sample", "name", "comment", "seq", "qual")))
                for sample, name, comment, seq, qual in rows:
                    if open_ is None or open_[0] != sample:
                        if open_ is not None:
                            open_[1].close()
                        check_name(sample)
                        files.create_dir(posixpath.join(folder, sample))
                        path = posixpath.join(folder, sample, f"part-{task:05d}-{len(found):03d}{self._suffix()}")
                        raw = files.open_output_stream(path, compression=None)
                        open_ = (sample, _Gzip(raw) if self.compress else raw)
                        found.append([sample, path, 0])
                    head = f"{name} {comment}" if comment else name
                    open_[1].write(f"@{head}\n{seq}\n+\n{qual}\n".encode())
                    found[-1][2] += 1
                    counts[sample] = counts.get(sample, 0) + 1
        finally:
            if open_ is not None:
                open_[1].close()
        return Written([tuple(f) for f in found])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _located(self.path)
        seen = set()
        for message in messages:
            for sample, path, _ in message.files if message else []:
                files.create_dir(posixpath.join(root, sample))
                files.move(path, posixpath.join(root, sample, posixpath.basename(path)))
                seen.add(sample)
        for sample in self.samples:
            if sample not in seen:
                files.create_dir(posixpath.join(root, sample))
                with files.open_output_stream(posixpath.join(root, sample, f"part-00000-000{self._suffix()}"), compression=None) as out:
                    out.write(gzip.compress(b"", LEVEL, mtime=0) if self.compress else b"")
        with files.open_output_stream(posixpath.join(root, "_samples.json"), compression=None) as out:
            reads = {s: 0 for s in self.samples}
            for message in messages:
                for sample, _, n in message.files if message else []:
                    reads[sample] = reads.get(sample, 0) + n
            out.write(json.dumps(reads, sort_keys=True).encode())
        self._drop(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_located(self.path))

    def _drop(self, files, root: str) -> None:
        """What no attempt of this job needs any more."""
        with suppress(FileNotFoundError):
            files.delete_dir(posixpath.join(root, PENDING, self.job))
        with suppress(FileNotFoundError, OSError):
            from pyarrow import fs

            if not files.get_file_info(fs.FileSelector(posixpath.join(root, PENDING))):
                files.delete_dir(posixpath.join(root, PENDING))


class _Gzip:
    """A gzip member over a stream, closed together; no time stamp, so equal reads give equal bytes."""

    def __init__(self, raw):
        self.raw, self.out = raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=LEVEL, mtime=0)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.raw.close()


class SampleSink(DataSource):
    """``df.write.format("fastq_by_sample").option("samples", json).mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fastq_by_sample"

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        if overwrite:
            raise ValueError("FASTQ files are added to a folder, not written over: name a new one")
        return SampleWriter(self.options["path"], json.loads(self.options.get("samples", "[]")), self.options.get("compress", "true") == "true")


def write_fastq_samples(assigned: DataFrame, path: str, declared: list[str], compress: bool = True) -> dict[str, int]:
    """Assigned reads (status, sample, name, comment, seq, qual) as FASTQ by sample, in order of src_index where there is one; the reads of each declared sample.

    Every declared sample has a folder with a readable file, also one without reads.
    """
    spark = assigned.sparkSession
    for name in declared:
        check_name(name)
    order = ["src_index"] if "src_index" in assigned.columns else []
    kept = assigned.filter(F.col("status") == "assigned")
    # Ranges over the order of reads split a sample that holds most of them over many tasks.
    placed = kept.repartitionByRange("sample", *order) if order else kept.repartition("sample")
    rows = placed.sortWithinPartitions("sample", *order).select("sample", "name", "comment", "seq", "qual")
    spark.dataSource.register(SampleSink)
    rows.write.format("fastq_by_sample").option("samples", json.dumps(sorted(set(declared)))).option("compress", str(compress).lower()).mode("append").save(path)
    return sample_counts(path)


def sample_counts(path: str) -> dict[str, int]:
    """The reads of each sample of a folder, as they were written."""
    files, root = _located(path)
    with files.open_input_stream(posixpath.join(root, "_samples.json"), compression=None) as stream:
        return json.loads(stream.read())


def read_fastq_sample(spark: SparkSession, path: str, sample: str) -> DataFrame:
    from pyarrow import fs

    files, root = _located(path)
    found = files.get_file_info(fs.FileSelector(posixpath.join(root, sample)))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return read_fastq(spark, *(scheme + f.path for f in found))
