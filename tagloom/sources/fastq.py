"""FASTQ in and out.

Reading is a Spark data source in Arrow batches. A plain file, or one in BGZF (gzip in blocks
that say how long they are), is read in ranges of bytes by many tasks; other gzip cannot be split
and takes a task a file. A range owns the records that begin behind its first byte, up to and with
the first byte of the next, so it needs to see nothing before it. A record begins where a line starts with @ and the
next but one with +, which no line of a quality can feign.

A record's src_index is its file's place in the sorted list times 2^40 plus its place
in the file, so the order of reads is known from the scan on. Where files are read in
ranges, one pass counts the records of each beforehand.
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bases import reverse_complement

SCHEMA = "src_index long, name string, comment string, seq string, qual string"
FILE_STEP = 1 << 40
BATCH = 8192
SPLIT = 64 << 20
CHUNK = 1 << 20


class FastqError(ValueError):
    pass


def records(lines: Iterator[bytes], where: str) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, seq, qual) of each record; line ends may be CRLF, the last may be missing."""
    number = 0
    while (head := next(lines, None)) is not None:
        four = [head, *(next(lines, None) for _ in range(3))]
        number += 1
        if None in four:
            raise FastqError(f"{where}: record {number} is cut off")
        head, seq, plus, qual = (x.rstrip(b"\r\n").decode() for x in four)
        if not head.startswith("@") or not plus.startswith("+"):
            raise FastqError(f"{where}: record {number} does not start with @ or its third line with +")
        if len(seq) != len(qual):
            raise FastqError(f"{where}: record {number} has {len(seq)} bases and {len(qual)} qualities")
        name, _, comment = head[1:].replace("\t", " ", 1).partition(" ") if " " not in head.split("\t", 1)[0] else head[1:].partition(" ")
        yield name, comment, seq, qual


def open_lines(path: str) -> Iterator[bytes]:
    """Lines of a plain or gzip file on any file system that pyarrow knows."""
    files, name = _located(path)
    stream = files.open_input_stream(name, compression=None)
    magic = stream.read(2)
    stream.close()
    raw = files.open_input_file(name)
    yield from gzip.open(raw, "rb") if magic == b"\x1f\x8b" else io.BufferedReader(raw)


class Range(InputPartition):
    """Bytes from ``begin`` to ``end`` (-1: to the end) of a file; its records are numbered from ``first``."""

    def __init__(self, path: str, begin: int, end: int, blocks: bool, first: int):
        self.path, self.begin, self.end, self.blocks, self.first = path, begin, end, blocks, first


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _block_size(head: bytes) -> int:
    """Bytes of the BGZF block that begins here, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= end:
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def ranges(paths: list[str], split: int) -> list[Range]:
    """The ranges of all files, their first numbers not known yet but for each file's first."""
    out = []
    for number, path in enumerate(sorted(paths)):
        files, name = _located(path)
        size = files.get_file_info(name).size or 0
        blocks = cut = False
        if size > split:
            with files.open_input_stream(name, compression=None) as stream:
                head = stream.read(64)
            blocks = _block_size(head) > 0
            cut = blocks or head[:2] != b"\x1f\x8b"
        begins = list(range(0, size, split)) if cut else [0]
        out += [Range(path, a, b, blocks, number * FILE_STEP if not a else -1) for a, b in zip(begins, [*begins[1:], -1])]
    return out


def _plain(raw, part: Range) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they lie behind the range) from the range's begin on."""
    raw.seek(part.begin)
    left = part.end - part.begin if part.end >= 0 else None
    while left is None or left > 0:
        data = raw.read(CHUNK if left is None else min(CHUNK, left))
        if not data:
            return
        left = left - len(data) if left is not None else None
        yield data, False
    while data := raw.read(1 << 16):
        yield data, True


def inflated(raw, path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, text) of the BGZF blocks of a file from byte ``begin`` on."""
    raw.seek(begin)
    held, at = raw.read(CHUNK), 0

    def more(n: int) -> None:
        nonlocal held, at
        while len(held) - at < n and (data := raw.read(CHUNK)):
            held, at = held[at:] + data, 0

    place = begin  # of held[at]
    while begin:  # the first block that another, or the end, follows where it says
        found = held.find(b"\x1f\x8b\x08\x04", at)
        if found < 0:
            keep = max(at, len(held) - 3)
            if not (data := raw.read(CHUNK)):
                return
            place, held, at = place + keep - at, held[keep:] + data, 0
            continue
        place, at = place + found - at, found
        more(1 << 17)
        size = _block_size(held[at : at + 1024])
        if size and (_block_size(held[at + size : at + size + 1024]) or len(held) == at + size):
            break
        place, at = place + 1, at + 1
    while True:
        more(1 << 16)
        size = _block_size(held[at : at + 1024])
        if not size:
            if len(held) > at:
                raise FastqError(f"{path}: no block at byte {place}")
            return
        if len(held) - at < size:
            raise FastqError(f"{path}: the block at byte {place} is cut off")
        yield place, zlib.decompress(held[at : at + size], 31)
        at, place = at + size, place + size


def _inflated(raw, part: Range) -> Iterator[tuple[bytes, bool]]:
    """The same of BGZF: text of the blocks that begin in the range, then of those behind it."""
    return ((text, 0 <= part.end <= place) for place, text in inflated(raw, part.path, part.begin))


def _owned(pieces: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[bytes]:
    """Lines of the records that a range owns."""
    limit, at, rest = None, 0, b""  # where the text behind the range begins; where the next line does
    skip = not first

    def lines() -> Iterator[tuple[int, bytes]]:
        nonlocal limit, at, rest, skip
        seen = 0
        for data, behind in pieces:
            if behind and limit is None:
                limit = seen
            seen += len(data)
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                start, at = at, at + len(line) + 1
                if skip:
                    skip = False
                else:
                    yield start, line + b"\n"
        if rest and not skip:
            yield at, rest

    ahead, found = [], first
    for start, line in lines():
        ahead.append((start, line))
        if not found:
            while len(ahead) >= 3 and not (ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+")):
                ahead.pop(0)
            found = len(ahead) >= 3
        if found and len(ahead) == 4:
            if limit is not None and ahead[0][0] > limit:
                return
            yield from (line for _, line in ahead)
            ahead = []
        elif limit is not None and ahead and ahead[0][0] > limit:
            return
    if found and ahead:
        yield from (line for _, line in ahead)


def range_lines(part: Range) -> Iterator[bytes]:
    files, name = _located(part.path)
    if part.begin == 0 and part.end < 0:
        yield from open_lines(part.path)
        return
    with files.open_input_file(name) as raw:
        yield from _owned((_inflated if part.blocks else _plain)(raw, part), part.begin == 0)


class FastqReader(DataSourceReader):
    def __init__(self, parts: list[Range]):
        self.parts = parts

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names, held, at = ("src_index", "name", "comment", "seq", "qual"), [], part.first
        for record in records(range_lines(part), part.path if not part.begin else f"{part.path} from byte {part.begin}"):
            held.append((at, *record))
            at += 1
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], list(names))
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], list(names))


class FastqSource(DataSource):
    """``spark.read.format("fastq").option("paths", "a.fq.gz,b.fq")``.

    With ``split`` and ``firsts``, the first src_index of every range, files are read in ranges (see ``read_fastq``).
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split(",") if p]
        firsts = json.loads(self.options.get("firsts", "[]"))
        parts = ranges(paths, int(self.options["split"]) if firsts else 1 << 62)
        for part, first in zip(parts, firsts):
            part.first = first
        return FastqReader(parts)


def _counted(spark: SparkSession, parts: list[Range]) -> list[int]:
    """Each range's first src_index: the records of the ranges before it in its file, counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path, begin, end, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                n = sum(1 for _ in range_lines(Range(path, begin, end, blocks, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([-(-n // 4)])], ["i", "n"])

    rows = [(i, p.path, p.begin, p.end, p.blocks) for i, p in enumerate(parts) if p.end >= 0]  # a file's last range needs no count
    some = spark.createDataFrame(rows, "i long, path string, begin long, end long, blocks boolean").repartition(len(rows), "i")
    n = dict(map(tuple, some.mapInArrow(run, "i long, n long").collect()))
    firsts: list[int] = []
    for i, part in enumerate(parts):
        firsts.append(part.first if not part.begin else firsts[-1] + n[i - 1])
    return firsts


def read_fastq(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """Reads of all files, in ranges of about ``split`` bytes where a file can be split."""
    spark.dataSource.register(FastqSource)
    parts = ranges(list(paths), split)
    source = spark.read.format("fastq").option("paths", ",".join(paths))
    if any(p.begin for p in parts):
        source = source.option("split", str(split)).option("firsts", json.dumps(_counted(spark, parts)))
    return source.load()


def read_pairs(spark: SparkSession, first: list[str], second: list[str]) -> DataFrame:
    """Mates joined by place, with seq2 and qual2; a read without its mate is an error when it is reached."""
    a = read_fastq(spark, *first)
    b = read_fastq(spark, *second).select("src_index", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = a.join(b, "src_index", "full")
    lone = F.raise_error(F.concat(F.lit("read without a mate at "), F.col("src_index").cast("string")))
    # A filter is kept whatever columns are read.
    return both.filter(F.when(F.col("seq").isNull() | F.col("seq2").isNull(), lone.cast("boolean")).otherwise(True))


def write_fastq(reads: DataFrame, path: str, compress: bool = True) -> None:
    """One file per partition, in src_index order through the files."""
    head = F.concat(F.lit("@"), F.concat_ws(" ", "name", F.when(F.length("comment") > 0, F.col("comment"))))
    text = reads.repartitionByRange("src_index").sortWithinPartitions("src_index").select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))
    text.write.text(path, compression="gzip" if compress else "none")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text as reads as sequenced: (name, flag, seq, qual, tags), tags as a map (see ``as_sequenced``)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    fields = lines.select(F.split("value", "\t").alias("f"))
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), t.substr(F.lit(6), F.length(t)))))
    rows = fields.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(9)).alias("seq"), F.get("f", F.lit(10)).alias("qual"), tags.alias("tags"))
    return as_sequenced(rows, path)


def as_sequenced(rows: DataFrame, path: str) -> DataFrame:
    """Alignment records (name, flag, seq, qual, tags) as reads.

    Records of the reverse strand are turned back; secondary and supplementary ones are
    no reads and left out. Paired and unpaired records in one file, and a read without
    RX, are errors.
    """
    rows = rows.filter(F.col("flag").bitwiseAND(0x900) == 0)
    paired = F.col("flag").bitwiseAND(1)
    low, high = rows.agg(F.min(paired), F.max(paired)).first()
    if low != high:
        raise ValueError(f"{path}: paired and unpaired records are mixed")
    turned = F.col("flag").bitwiseAND(0x10) != 0
    out = rows.select("name", "flag", F.when(turned, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(turned & (F.col("qual") != "*"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "tags")
    without = F.raise_error(F.concat(F.lit("read without RX: "), F.col("name")))
    return out.filter(F.when(F.length(F.coalesce(F.col("tags")["RX"], F.lit(""))) == 0, without.cast("boolean")).otherwise(True))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(cell): one per line; blank lines, # and what follows a dash are dropped; one length only."""
    cells = spark.read.text(path).select(F.substring_index(F.trim("value"), "-", 1).alias("cell")).filter((F.length("cell") > 0) & ~F.col("cell").startswith("#")).distinct()
    low, high = cells.agg(F.min(F.length("cell")), F.max(F.length("cell"))).first()
    if low != high:
        raise ValueError(f"{path}: cells of {low} and of {high} bases")
    return cells


def read_sheet(lines: list[str]) -> list[dict[str, str | None]]:
    """Rows of sample, pattern, slave, r1, r2, TAB or space separated; ``.`` and empty are null, # is a comment."""
    from ..plans.layout import check_name, compile_layout

    names, out = ("sample", "pattern", "slave", "r1", "r2"), []
    for number, line in enumerate(lines, 1):
        if not (line := line.split("#", 1)[0].strip()):
            continue
        fields = [None if f in ("", ".") else f for f in (line.split("\t") if "\t" in line else line.split())]
        row = dict(zip(names, fields + [None] * 5))
        if not row["sample"] or not row["pattern"]:
            raise ValueError(f"sheet line {number}: a sample and a pattern are needed")
        try:
            check_name(row["sample"])
            compile_layout(row["pattern"])
        except ValueError as e:
            raise ValueError(f"sheet line {number}: {e}") from None
        out.append(row)
    return out
