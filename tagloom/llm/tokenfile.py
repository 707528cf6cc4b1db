"""Token ids in Arrow files of fixed-size lists, for zero-copy random access.

Documents are laid end to end in ascending doc_id order, each followed by an end
id, and cut into sequences of ``width`` ids. Every shard is one Arrow IPC file
whose record batches hold two columns, ``ids`` (fixed-size list of the narrowest
unsigned integer that holds the vocabulary) and ``mask`` (fixed-size list of
booleans, false where the shard's last sequence is padded). A second small file
per shard lists its documents: doc_id, first id, number of ids. Batches are not
compressed, so sequence k of a memory-mapped shard is a view into the file.

A shard is a range of doc_ids, sorted and written by one task; it appears under
its final name by a rename after it is complete, so a repeated task only writes
the same bytes again. Nothing but one line per shard reaches the driver.

Each worker tokenizes a piece of text between spaces once and remembers it from task
to task, for a bounded number of pieces. That is exact where no token crosses a space, which
``checked`` verifies on the tokenizer's own description; others encode whole texts.

Defined cases: a null or empty text is just the end id; rows with equal doc_ids
stand in the order of their texts; a null doc_id comes first; an empty table
gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch

END_ID = 1
WIDTH = 2048
BATCH_ROWS = 64
REMEMBERED = 400_000  # pieces of text in a worker, and twice as many words


#: Fixed value: a pattern of words under which a run of letters is one word, and a run of these marks after it another.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at which Python's split parts words but the tokenizers' white space does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Such pieces in Latin-1, whose letters NFC leaves as they are.
MARKS = ".,;:!?%&*$#|"
PLAIN_PIECE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*$#|]*)")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the letters from 256 on."""
    rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + n for n, b in enumerate(rest)}


class SplitTokenizer(dict):
    """Pieces of text between spaces -> their ids as bytes of ``kind``.

    The library's normalizer, pre-tokenizer and model do the work, once per piece
    and once per word in it; they are called one by one as that skips the offsets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        self.by_piece, self.plain = checked(t)
        self.kind = np.dtype("<u2" if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [a.content for a in t.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.as_bytes = [i.to_bytes(self.kind.itemsize, "little") for i in range(t.get_vocab_size(with_added_tokens=True))]
        self.letters = byte_letters()
        if self.by_piece:
            self.normalize, self.split, self.model = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str, t.model.tokenize

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = b"".join([self.as_bytes[t.id] for t in self.model(word)])
        return ids

    def __missing__(self, piece: str) -> bytes:
        if self.plain:
            word = piece.rstrip(MARKS)
            if word.isascii() and word.isalpha():  # most are: ``PLAIN_PIECE`` without its search
                size, word = len(word), word.lower()
                ids = self.words.get(word) or self._word(word)
                if size != len(piece):
                    ids += self._word(piece[size:])
                self[piece] = ids
                return ids
        if self.plain and (found := PLAIN_PIECE.fullmatch(piece)):
            word, marks = found.groups()
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = self._word(word) + self._word(marks) if marks else self._word(word)
        elif any(a in piece for a in self.added):
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()
        else:
            ids = b"".join([self._word(w) for w, _ in self.split(self.normalize(piece))])
        self[piece] = ids
        return ids

    def encode(self, text: str, end: bytes = b"") -> np.ndarray:
        """The text's ids, followed by those of ``end``."""
        if not self.by_piece:
            return np.frombuffer(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + end, self.kind)
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.words) > 2 * REMEMBERED:
            self.words.clear()
        pieces = re.split("[ \t\n\r]+", text) if any(c in text for c in SEPARATORS) else text.split()
        ids = list(map(self.__getitem__, pieces))
        ids.append(end)
        return np.frombuffer(b"".join(ids), self.kind)


def checked(tokenizer) -> tuple[bool, bool]:
    """Whether spaces only part words in this tokenizer, by its description; and whether its words follow ``WORD_PATTERN`` in lower case."""
    d = json.loads(tokenizer.to_str())
    norm = [n.get("type") for n in (d["normalizer"] or {}).get("normalizers", [d["normalizer"] or {}])]
    pre = (d["pre_tokenizer"] or {}).get("pretokenizers", [d["pre_tokenizer"] or {}])
    drops = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and r"[^\s" in pre[0]["pattern"].get("Regex", "")
    added = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])) for t in d["added_tokens"])
    prefix = any(p.get("add_prefix_space") for p in pre)
    by_piece = bool(drops and added and not prefix and set(norm) <= {"NFC", "Lowercase", "Replace"} and not d.get("truncation") and not d.get("padding"))
    return by_piece, by_piece and pre[0]["pattern"]["Regex"] == WORD_PATTERN and "Lowercase" in norm and [p["type"] for p in pre] == ["Split", "ByteLevel"]


def kept(path: str) -> SplitTokenizer:
    """The tokenizer in a file, with the pieces that this worker met in earlier tasks; read anew if the file has changed.

    Functions travel with each task, and this module's own globals with them, so it is kept in a module made in the worker.
    """
    worker = sys.modules.setdefault("_tagloom_worker", ModuleType("_tagloom_worker"))
    at = os.stat(path)
    key = (str(path), at.st_mtime_ns, at.st_size)
    if getattr(worker, "key", None) != key:
        worker.key, worker.tokenizer = None, None
        worker.tokenizer, worker.key = SplitTokenizer(path), key
    return worker.tokenizer


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class ShardWriter:
    """Fills fixed-size lists with one document after another."""

    def __init__(self, folder: str, shard: int, width: int, kind: np.dtype, attempt: str):
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/ids-{shard:06d}.arrow", f"{root}/docs-{shard:06d}.arrow"]
        self.part = [f"{p}.{attempt}" for p in self.final]
        self.width, self.kind, self.total = width, np.dtype(kind), 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), width)), ("mask", pa.list_(pa.bool_(), width))])
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
        self.files = [self.fs.open_output_stream(p) for p in self.part]
        self.out, self.doc_out = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.doc_schema)))
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_ids: pa.Array, flat: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        first = self.total + np.cumsum(sizes) - sizes
        self.doc_out.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(first), pa.array(sizes)], schema=self.doc_schema))
        self.total += int(sizes.sum())
        self.held += flat
        self.n_held += int(sizes.sum())
        if self.n_held >= self.width * BATCH_ROWS:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        step = self.width * BATCH_ROWS
        while len(flat) >= step or last and len(flat):
            now, flat = flat[:step], flat[step:]
            rows = -(-len(now) // self.width)
            mask = np.arange(rows * self.width) < len(now)
            now = np.r_[now, np.zeros(rows * self.width - len(now), self.kind)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (now, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n_held = [flat.copy()], len(flat)

    def close(self) -> int:
        self._write(last=True)
        for out, file in zip((self.out, self.doc_out), self.files):
            out.close()
            file.close()
        for part, final in zip(self.part, self.final):
            self.fs.move(part, final)
        return self.total


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, order: list | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID) -> list[tuple[int, int]]:
    """Write the files; returns (shard, ids in it), ascending.

    ``order``: columns to lay the documents out by, ascending doc_id if none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, words = TaskContext.get(), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    words = kept(tokenizer)
                    writer = ShardWriter(folder, task.partitionId(), width, words.kind, f"{task.taskAttemptId()}.tmp")
                    end = np.array([end_id], words.kind).tobytes()
                writer.add(part.column(0), [words.encode(t or "", end) for t in part.column(1).to_pylist()])
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n": [writer.close()]}, pa.schema([("shard", pa.int32()), ("n", pa.int64())]))

    keys = [F.col(id_col), F.xxhash64(text_col)] if order is None else [F.col(c) for c in order]
    named = {c: F.col(c) for c in docs.columns}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)]) if named else docs
    keys = [f"_k{i}" for i in range(len(keys))]
    laid = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys, "text")
    done = laid.select("doc_id", "text").mapInArrow(run, "shard int, n long").collect()
    return sorted((r.shard, r.n) for r in done)


def read_shard(folder: str, shard: int) -> tuple[np.ndarray, pa.Table]:
    """(all ids of a shard, its documents). A local file is mapped, and its ids are views."""
    fs, root = _open(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    ids, docs = (pa.memory_map(p) if local else fs.open_input_file(p) for p in (f"{root}/ids-{shard:06d}.arrow", f"{root}/docs-{shard:06d}.arrow"))
    batches = pa.ipc.open_file(ids)
    parts = []
    for i in range(batches.num_record_batches):
        batch = batches.get_batch(i)
        flat = batch.column(0).flatten().to_numpy()
        n = int(pa.compute.sum(batch.column(1).flatten()).as_py()) if i == batches.num_record_batches - 1 else len(flat)
        parts.append(flat[:n])
    return _Parts(parts), pa.ipc.open_file(docs).read_all()


class _Parts:
    """The ids of a shard's batches as one sequence; a slice within one batch is a view."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.starts = parts, np.cumsum([0, *map(len, parts)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def slice(self, first: int, n: int) -> np.ndarray:
        i, out = int(np.searchsorted(self.starts, first, "right")) - 1, []
        while n > 0:
            at = first - int(self.starts[i])
            out.append(self.parts[i][at : at + n])
            first, n, i = first + len(out[-1]), n - len(out[-1]), i + 1
        return out[0] if len(out) == 1 else np.concatenate(out)


def sequence(folder: str, shard: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``row`` of a shard and its mask, without reading the rest."""
    import pyarrow.compute  # noqa: F401

    fs, root = _open(folder)
    name = f"{root}/ids-{shard:06d}.arrow"
    file = pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))
    batch, at = file.get_batch(row // BATCH_ROWS), row % BATCH_ROWS
    return tuple(batch.column(i)[at].values.to_numpy(zero_copy_only=i == 0) for i in (0, 1))


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    starts, total = [], 0
    for shard, n in shards:
        starts.append((shard, total))
        total += n
    kinds = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                ids, docs = read_shard(folder, shard)
                for part in docs.to_batches(max_chunksize=4096):
                    first, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = [zlib.crc32(ids.slice(f, k).astype("<u4")) for f, k in zip(first.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(starts, kinds).repartition(max(1, len(starts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, order: list | None = None, **options) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what they hold."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, order, **options))
