"""BAM as reads: binary alignment records in BGZF blocks, read in ranges by many tasks.

Ranges of bytes are planned first: a task finds the first record of its range, by fields that must
fit each other over several records, and goes on to the first record of the next. That must be the
one that the next task found, or the file is refused; so what is read are stretches between virtual
offsets (a block's place in the file, a record's place in its text) that are known to meet.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fastq import BATCH, SPLIT, FastqError, _located, as_sequenced, inflated

SCHEMA = "name string, flag int, seq string, qual string, tags map<string,string>"
LETTERS = "=ACMGRSVTWYHKDBN"  # fixed value: bases by their four bits
FIXED = "<iiBBHHHiiii"  # fixed value: the fields before the name, of 32 bytes
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}  # fixed value: tag types as struct has them
MOST_BYTES = 1 << 26  # of a record
CHAINED = 4  # records that must fit where a range begins
_PAIRS = [a + b for a in LETTERS for b in LETTERS]


class Text:
    """The text of blocks from one on, as far as it is needed; ``at`` counts from the first block's beginning."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.held, self.base = blocks, b"", 0
        self.starts: list[tuple[int, int]] = []  # of blocks: where their text begins, their place in the file
        self.ended = False

    def upto(self, end: int) -> bool:
        """Whether there is text up to ``end``."""
        while self.base + len(self.held) < end and not self.ended:
            if (block := next(self.blocks, None)) is None:
                self.ended = True
            else:
                self.starts.append((self.base + len(self.held), block[0]))
                self.held += block[1]
        return self.base + len(self.held) >= end

    def get(self, begin: int, end: int) -> bytes:
        return self.held[begin - self.base : end - self.base]

    def forget(self, at: int) -> None:
        if at - self.base > 1 << 20:
            self.held, self.base = self.held[at - self.base :], at

    def offset(self, at: int) -> tuple[int, int] | None:
        """The virtual offset of ``at``; None at the end of the file."""
        if not self.upto(at + 1):
            return None
        start, place = max(s for s in self.starts if s[0] <= at)
        return place, at - start


def header(text: Text) -> tuple[int, int]:
    """(where the records begin, number of references)."""
    if not text.upto(12) or text.get(0, 4) != b"BAM\1":
        raise FastqError("no BAM header")
    at = 8 + struct.unpack("<i", text.get(4, 8))[0]
    text.upto(at + 4)
    (n,) = struct.unpack("<i", text.get(at, at + 4))
    at += 4
    for _ in range(n):
        text.upto(at + 4)
        at += 8 + struct.unpack("<i", text.get(at, at + 4))[0]
    return at, n


def _fits(text: Text, at: int, references: int) -> bool:
    """Whether records may begin here: ``CHAINED`` of them, or all up to the end."""
    for _ in range(CHAINED):
        if not text.upto(at + 36):
            return text.base + len(text.held) == at
        (size,) = struct.unpack("<i", text.get(at, at + 4))
        ref, pos, name, _, _, cigar, _, n, next_ref, next_pos, _ = struct.unpack(FIXED, text.get(at + 4, at + 36))
        least = 32 + name + 4 * cigar + (n + 1) // 2 + n
        if not (0 <= n and least <= size <= MOST_BYTES and -1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and name) or not text.upto(at + 4 + size):
            return False
        letters = text.get(at + 36, at + 36 + name)
        if letters[-1] or not all(33 <= c <= 126 for c in letters[:-1]):
            return False
        at += 4 + size
    return True


def _stretch(path: str, begin: int, end: int, references: int, first: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """Virtual offsets of the first record that begins in the range, and of the first behind it; None for none."""
    files, name = _located(path)
    with files.open_input_file(name) as raw:
        text = Text(inflated(raw, path, begin))

        def inside(at: int) -> bool:
            here = text.offset(at)
            return here is not None and (end < 0 or here[0] < end)

        at = first
        if begin:
            at = 0
            while inside(at) and not _fits(text, at, references):
                at += 1
        if not inside(at):
            return None, None
        start = text.offset(at)
        while inside(at):
            text.forget(at)
            if not text.upto(at + 4):
                raise FastqError(f"{path}: the last record is cut off")
            at += 4 + struct.unpack("<i", text.get(at, at + 4))[0]
        return start, text.offset(at)


def decoded(data: bytes) -> tuple[str, int, str, str, list[tuple[str, str]]]:
    """(name, flag, seq, qual, tags) of a record behind its size; tags as SAM text has them."""
    _, _, name, _, _, cigar, flag, n, *_ = struct.unpack_from(FIXED, data)
    at = 32 + name + 4 * cigar
    seq = "".join(map(_PAIRS.__getitem__, data[at : at + (n + 1) // 2]))[:n] or "*"
    at += (n + 1) // 2
    marks = data[at : at + n]
    qual = "*" if not n or marks[0] == 255 else bytes(min(q + 33, 126) for q in marks).decode()
    at += n
    tags = []
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, (m,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            form = f"<{m}{NUMBERS[sub]}"
            value = ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in struct.unpack_from(form, data, at + 5))])
            at += 5 + struct.calcsize(form)
        else:
            (v,) = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)
            value, at = f"{v:g}" if kind == "f" else str(v), at + struct.calcsize(NUMBERS[kind])
        tags.append((key, value))
    return data[32 : 32 + name - 1].decode(), flag, seq, qual, tags


class Stretch(InputPartition):
    """Records from one virtual offset to another (none: to the end)."""

    def __init__(self, path: str, start: tuple[int, int], end: tuple[int, int] | None):
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, parts: list[Stretch]):
        self.parts = parts

    def partitions(self) -> list[InputPartition]:
        return self.parts or [Stretch("", (0, 0), None)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for record in stretch_records(part) if part.path else ():
            held.append(record)
            if len(held) == BATCH:
                yield _batch(held)
                held = []
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["name", "flag", "seq", "qual", "tags"])


def stretch_records(part: Stretch) -> Iterator[tuple]:
    files, name = _located(part.path)
    with files.open_input_file(name) as raw:
        text = Text(inflated(raw, part.path, part.start[0]))
        at = part.start[1]
        while (here := text.offset(at)) is not None and here != part.end:
            text.forget(at)
            (size,) = struct.unpack("<i", text.get(at, at + 4)) if text.upto(at + 4) else (0,)
            if not size or not text.upto(at + 4 + size):
                raise FastqError(f"{part.path}: the last record is cut off")
            yield decoded(text.get(at + 4, at + 4 + size))
            at += 4 + size


class BamSource(DataSource):
    """``spark.read.format("bam")`` over stretches that ``read_bam`` has planned."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader([Stretch(path, tuple(start), end and tuple(end)) for path, start, end in json.loads(self.options["stretches"])])


def stretches(spark: SparkSession, path: str, split: int) -> list[tuple[str, tuple[int, int], tuple[int, int] | None]]:
    """(path, start, end) of stretches of about ``split`` bytes, found in tasks and checked to meet."""
    files, name = _located(path)
    size = files.get_file_info(name).size
    with files.open_input_file(name) as raw:
        first, references = header(Text(inflated(raw, path, 0)))
    begins = list(range(0, size, split))
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(begins, [*begins[1:], -1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                found = json.dumps(_stretch(path, begin, end, references, first))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([found])], ["i", "found"])

    planned = spark.createDataFrame(rows, "i long, begin long, end long").repartition(len(rows), "i").mapInArrow(run, "i long, found string")
    found = [json.loads(r["found"]) for r in planned.orderBy("i").collect()]
    some = [(start, end) for start, end in found if start is not None]
    for (_, end), (start, _) in zip(some, some[1:]):
        if end != start:
            raise FastqError(f"{path}: records do not meet at {start}; read it with a larger split")
    return [(path, tuple(start), end and tuple(end)) for start, end in some]


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Reads as sequenced: (name, flag, seq, qual, tags), as ``read_sam`` gives them of the same records."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("stretches", json.dumps(stretches(spark, path, split))).load()
    return as_sequenced(rows, path)
