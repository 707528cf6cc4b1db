"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are the lower-cased words of a text and one end. A token's context is the
whole word before it (the start of a text is a context of its own), told apart by
hashes into ``CONTEXTS`` restaurants. Every context's restaurant sends a customer for
each of its tables to one restaurant that all share, the unigrams; its tables draw
from the uniform measure over the V words seen in training and one unknown. Dishes,
one per (context, word) pair of the corpus, are all kept, told apart by 64 bits of the
word and the context's number.

Seating is sampled by Gibbs sweeps. In a sweep all dishes seat their customers anew,
given the tables of the other dishes in their restaurant and the shared restaurant's
probabilities as of the sweep before (a blocked, parallel Gibbs step with a Metropolis
test against the old seating); then the shared restaurant seats the tables as its
customers. Predictive probabilities are averaged over the last ``KEPT`` of ``SWEEPS``
sweeps. Discounts come from the counts of counts. From the ``SINGLE``-th customer of a
dish on, customers are seated in growing batches. Each dish draws its numbers from a
hash of word, context, sweep and step, so results do not depend on partitions.

As a Spark job. Pieces of the input of about ``CHUNK_BYTES`` become chunks: their
documents as indices into the chunk's distinct pairs, and these pairs with their
training counts, dealt to buckets by a hash of the word. There is a bucket per
``BUCKET_BYTES`` of text, so none grows with the corpus; a word's dishes are at most
``CONTEXTS``. A bucket adds up its words' counts over all chunks; everything about a
word is then in one bucket, with the places of each chunk's pairs in it. Sweeps exchange
sums per context, of which a bucket sends those that are not zero, added up in blocks
by Spark; their arrays of ``CONTEXTS`` numbers go to all tasks. At the end each bucket
answers each chunk, and chunks add up their documents' scores. A hot word or context is
one entry per chunk, however often it occurs. Each step is a table in the shared folder:
a lost executor costs its tasks.

Defined cases: a null or empty text is just an end; a document with a null id is
trained on; repeated rows count and are scored each for itself; with no training
rows all words are unknown and share the uniform measure over one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, tidy

CONTEXT_BITS = 22
CONTEXTS = 1 << CONTEXT_BITS
BLOCK_BITS = 16
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 6_000_000
SWEEPS = 5
KEPT = 3
STRENGTH = (1.0, 1.0)  # of the context restaurants and the shared one
SINGLE = 1024
SEED = 5
END = b" end"  # no word holds a space


class Chunk:
    """Documents of one piece of the input, until it is full."""

    def __init__(self):
        self.words: dict[bytes, int] = {END: 0}
        self.ids, self.sizes, self.train, self.flat, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, train: bool, text: bytes) -> None:
        known = self.words
        words = text.lower().split()
        new = [known.setdefault(w, len(known)) for w in words]
        new.append(0)
        self.flat.append(np.array(new, np.int32))
        self.ids.append(doc_id)
        self.sizes.append(len(new))
        self.train.append(train)
        self.bytes += len(text) + 64

    def pairs(self, buckets: int) -> tuple:
        """(word hashes, contexts, training counts) of the distinct pairs, by bucket, word and context, and each token's pair."""
        import xxhash

        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        order = np.lexsort((hashes, hashes % np.uint64(buckets)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # words by bucket, so that sorting pairs deals them out
        contexts = context_of(hashes)
        flat, sizes = np.concatenate(self.flat), np.array(self.sizes)
        before = np.r_[0, contexts[flat[:-1]]]
        before[np.cumsum(sizes) - sizes] = 0
        pairs, at = np.unique(rank[flat] << CONTEXT_BITS | before, return_inverse=True)
        counts = np.bincount(at[np.repeat(self.train, sizes)], minlength=len(pairs))
        return hashes[order][pairs >> CONTEXT_BITS], (pairs & (CONTEXTS - 1)).astype(np.int32), counts, at


def context_of(hashes: np.ndarray) -> np.ndarray:
    """The restaurants of words; 0 is that of the start."""
    return (1 + (hashes >> np.uint64(17)) % np.uint64(CONTEXTS - 1)).astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    """Compressed, as shuffles write them."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _array(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _starts(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)


#: In rows of kind ``docs``, ``words`` has the documents' pairs: each document's sorted, as differences. In those of kind ``pairs``, each word once, and ``runs`` how many pairs it has.
CHUNKS = "kind string, chunk long, bucket int, words binary, runs binary, contexts binary, counts binary, ids array<long>, sizes array<int>"


def _chunks(docs: DataFrame, train: Column, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows of kind ``docs`` (a chunk's documents) and ``pairs`` (a chunk's pairs in a bucket)."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))))

    def told(chunk: Chunk, number: int) -> Iterator[pa.RecordBatch]:
        words, contexts, counts, at = chunk.pairs(buckets)
        ends = np.cumsum(np.bincount((words % np.uint64(buckets)).astype(np.int64), minlength=buckets))
        rows = []
        for b, (start, end) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            if start < end:
                first = _starts(words[start:end])
                runs = np.diff(np.r_[first, end - start]).astype(np.int32)
                rows.append(("pairs", number, b, _bytes(words[start:end][first]), _bytes(runs), _bytes(contexts[start:end]), _bytes(counts[start:end].astype(np.int32)), None, None))
        sizes = np.array(chunk.sizes)
        at = np.sort(np.repeat(np.arange(len(sizes)) << 32, sizes) | at) & ((1 << 32) - 1)
        steps = np.diff(at, prepend=0)
        first = np.cumsum(sizes) - sizes
        steps[first] = at[first]
        rows.append(("docs", number, -1, _bytes(steps.astype(np.int32)), None, None, None, chunk.ids, chunk.sizes))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for doc_id, trains, text in zip(batch.column(0), batch.column(1), texts):
                chunk.add(doc_id.as_py(), trains.as_py(), text.as_py() or b"")
                if chunk.bytes >= CHUNK_BYTES:
                    yield from told(chunk, number)
                    chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield from told(chunk, number)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def _noise(keys: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Even numbers between 0 and 1, by splitmix64's mixing of key, sweep and step."""
    x = keys + np.uint64(((SEED * 1000 + sweep) * 4_000_037 + step) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(counts: np.ndarray, base: np.ndarray, slope: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log weight) of dishes whose ``counts`` customers, one at least, sit down one after another.

    A newcomer opens a table in proportion to ``base + slope * tables``, its dish's
    tables so far, and joins one in proportion to customers - discount * tables.
    """
    order = np.argsort(-counts, kind="stable")
    n, base, slope, keys = counts[order], base[order], slope[order], keys[order]
    tables = np.ones(len(n))
    weight = np.log(np.maximum(base, 1e-300))
    live, seated, step = int((n > 1).sum()), 1, 1
    while live:
        batch = 1 if seated < SINGLE else seated // 16
        take = np.minimum(batch, n[:live] - seated)
        opens = base[:live] + slope[:live] * tables[:live]
        joins = np.maximum(seated - discount * tables[:live], 1e-12)
        p = opens / (opens + joins)
        weight[:live] += take * np.log(opens + joins)
        even = _noise(keys[:live], sweep, step)
        if batch == 1:
            tables[:live] += even < p
        else:  # of so many, about normal
            normal = np.sqrt(-2 * np.log(1 - even)) * np.cos(2 * np.pi * _noise(keys[:live], sweep, step + 2_000_000))
            tables[:live] += np.clip(np.rint(take * p + normal * np.sqrt(take * p * (1 - p))), 0, take)
        seated, step = seated + batch, step + 1
        live = int(np.searchsorted(-n[:live], -seated, "left"))
    out, weights = np.empty(len(n), np.int64), np.empty(len(n))
    out[order], weights[order] = tables.astype(np.int64), weight
    return out, weights


class Totals(NamedTuple):
    """What sweeps exchange: sums over all buckets, of bounded size."""

    customers: np.ndarray | None  # of each context's restaurant
    tables: np.ndarray
    words: int  # V
    tokens: int  # N
    shared_customers: int
    shared_tables: int
    discounts: tuple[float, float]


#: What a bucket has once, and what sweeps change: of the dishes only those of more than one customer, as one customer has one table.
FIXED = {"runs": np.int32, "contexts": np.int32, "counts": np.int32}
SEATED = {"words": np.uint64, "singles": np.int32, "many": np.int32, "contexts": np.int32, "counts": np.int32, "tables": np.int32, "weights": np.float32, "own": np.int32, "shared_tables": np.int32, "shared_weights": np.float32}
#: Rows of kind ``sums`` have numbers ``n`` at the places ``at`` of a block of contexts, or in block -1 the sums that have no context.
STATE_FIELDS = [
    ("kind", pa.string()), ("bucket", pa.int32()), ("name", pa.string()), ("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary()),
    *((a, pa.binary()) for a in {**FIXED, **SEATED}), ("kept", pa.list_(pa.binary())), ("chunks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())),
]
STATE_SCHEMA = pa.schema(STATE_FIELDS)
_DDL = {pa.string(): "string", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int64()): "array<long>"}
STATE = ", ".join(f"{name} {_DDL[kind]}" for name, kind in STATE_FIELDS)


def _sum_rows(bucket: Bucket, *sums: tuple[str, np.ndarray, np.ndarray], pairs: np.ndarray | None = None) -> list[dict]:
    """Rows of the sums (name, context, number) that other buckets need, and of those without a context."""
    out = []
    for name, contexts, numbers in sums:
        at, place = np.unique(contexts, return_inverse=True)
        n = np.bincount(place, numbers, len(at)).astype(np.int32)
        cuts = np.searchsorted(at, np.arange((CONTEXTS >> BLOCK_BITS) + 1) << BLOCK_BITS)
        for block, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if low < high:
                out.append({"kind": "sums", "name": name, "block": block, "at": _bytes((at[low:high] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)), "n": _bytes(n[low:high])})
    shared = bucket.shared
    alone = [(shared > 0).sum(), shared.sum(), bucket.shared_tables.sum(), (shared == 1).sum(), (shared == 2).sum()]
    alone += [pairs.sum(), (pairs == 1).sum(), (pairs == 2).sum()] if pairs is not None else [0, 0, 0]
    out.append({"kind": "sums", "name": "one", "block": -1, "n": _bytes(np.array(alone, np.int64))})
    return out


class Bucket:
    """The words of a bucket and their dishes of more than one customer, sorted by word and context, as arrays."""

    def __init__(self, number: int, words: np.ndarray, word_of: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        some, n = counts > 1, len(words)
        self.number, self.words, self.contexts, self.counts = number, words, contexts[some], counts[some]
        self.singles, self.many = np.bincount(word_of[counts == 1], minlength=n), np.bincount(word_of[some], minlength=n)
        self.tables, self.weights, self.own = np.ones(len(self.counts), np.int64), np.zeros(len(self.counts)), np.zeros(len(self.counts), np.int64)
        self.kept: list[np.ndarray] = []
        self._indexed()
        self.shared_tables, self.shared_weights = (self.shared > 0).astype(np.int64), np.zeros(n)

    def _indexed(self) -> None:
        self.word_of = np.repeat(np.arange(len(self.words)), self.many)
        self._share()

    def _share(self) -> None:
        """The shared restaurant's customers: one from each table."""
        self.shared = self.singles + np.bincount(self.word_of, self.tables, len(self.words)).astype(np.int64)

    @classmethod
    def read(cls, row: dict) -> Bucket:
        self = cls.__new__(cls)
        for name, kind in SEATED.items():
            setattr(self, name, _array(row[name], kind))
        self.number, self.kept = row["bucket"], [_array(x, np.int32) for x in row["kept"]]
        self._indexed()
        return self

    def row(self) -> dict:
        return {"kind": "state", "bucket": self.number, "kept": [_bytes(k.astype(np.int32)) for k in self.kept]} | {n: _bytes(np.asarray(getattr(self, n)).astype(k)) for n, k in SEATED.items()}

    def more_tables(self) -> tuple[str, np.ndarray, np.ndarray]:
        some = self.tables > 1
        return "more", self.contexts[some], self.tables[some] - 1

    def shared_probability(self, t: Totals) -> np.ndarray:
        d, strength = t.discounts[1], STRENGTH[1]
        spare = (strength + d * t.shared_tables) / (t.words + 1)
        return (self.shared - d * self.shared_tables + spare) / (strength + t.shared_customers)

    def sweep(self, t: Totals, number: int, keep: bool) -> None:
        if len(self.counts):
            p = self.shared_probability(t)[self.word_of]
            d = t.discounts[0]
            others = STRENGTH[0] + d * np.maximum(0, t.tables[self.contexts] - self.tables)
            keys = (self.words[self.word_of] ^ (self.contexts.astype(np.uint64) << np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.tables, self.weights = self._tested(*seat(self.counts, others * p, d * p, d, keys, 2 * number), self.tables, self.weights, keys, number)
            self._share()
        some = np.flatnonzero(self.shared > 0)
        if len(some):
            d, even = t.discounts[1], 1 / (t.words + 1)
            others = STRENGTH[1] + d * np.maximum(0, t.shared_tables - self.shared_tables[some])
            keys = self.words[some] * np.uint64(0xA0761D6478BD642F)
            old = np.minimum(self.shared_tables[some], self.shared[some])
            tables, weights = self._tested(*seat(self.shared[some], others * even, np.full(len(some), d * even), d, keys, 2 * number + 1), old, self.shared_weights[some], keys, number)
            self.shared_tables, self.shared_weights = self.shared_tables.copy(), self.shared_weights.copy()
            self.shared_tables[some], self.shared_weights[some] = tables, weights
        if keep:
            self.own = self.own + self.tables
            self.kept = [*self.kept, self.shared, self.shared_tables]

    @staticmethod
    def _tested(new: np.ndarray, weight: np.ndarray, old: np.ndarray, old_weight: np.ndarray, keys: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The new seating where it passes the Metropolis test; the first sweep has no old one."""
        if number == 0:
            return new, weight
        take = np.log(1 - _noise(keys, number, 3_000_000)) < weight - old_weight
        return np.where(take, new, old), np.where(take, weight, old_weight)


def _grouped(run):
    """``run`` with the type hints by which Spark hands over a group batch by batch."""

    def grouped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, batches)

    grouped.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped


def _counted(pairs: DataFrame) -> DataFrame:
    """The state of every bucket, each dish of training at one table, with the places of each chunk's pairs."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for chunk, words, runs, contexts, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))):
                parts.append((chunk, _array(words, np.uint64), _array(runs, np.int32), _array(contexts, np.int32), _array(counts, np.int32)))
        words = np.unique(np.concatenate([p[1] for p in parts]))

        def codes(part: tuple) -> np.ndarray:
            return np.repeat(np.searchsorted(words, part[1]), part[2]) << CONTEXT_BITS | part[3]

        dishes = np.unique(np.concatenate([codes(p) for p in parts]))
        counts = np.zeros(len(dishes), np.int64)
        chunks, places = [], []
        for part in parts:
            at = np.searchsorted(dishes, codes(part))
            counts[at] += part[4]  # a chunk has a pair once
            chunks.append(part[0])
            places.append(_bytes(np.diff(at, prepend=0).astype(np.int32)))
        first = _starts(dishes >> CONTEXT_BITS)
        contexts = (dishes & (CONTEXTS - 1)).astype(np.int32)
        runs, seen = np.diff(np.r_[first, len(dishes)]).astype(np.int32), counts > 0
        bucket = Bucket(key[0].as_py(), words, dishes >> CONTEXT_BITS, contexts, counts)
        fixed = {"kind": "fixed", "bucket": bucket.number, "runs": _bytes(runs), "contexts": _bytes(contexts), "counts": _bytes(counts.astype(np.int32)), "chunks": chunks, "places": places}
        yield pa.RecordBatch.from_pylist([fixed], STATE_SCHEMA)
        sums = _sum_rows(bucket, ("customers", contexts[seen], counts[seen]), ("dishes", contexts[seen], np.ones(int(seen.sum()))), pairs=counts)
        yield pa.RecordBatch.from_pylist([bucket.row(), *sums], STATE_SCHEMA)

    return pairs.select("bucket", "chunk", "words", "runs", "contexts", "counts").groupBy("bucket").applyInArrow(_grouped(run), STATE)


def _swept(state: DataFrame, sent, number: int, keep: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = Bucket.read(batch.slice(i, 1).to_pylist()[0])
                bucket.sweep(Totals(*sent.value), number, keep)
                yield pa.RecordBatch.from_pylist([bucket.row(), *_sum_rows(bucket, bucket.more_tables())], STATE_SCHEMA)

    return state.mapInArrow(run, STATE)


def _summed_up(sums: DataFrame) -> dict[str, np.ndarray]:
    """The sums of all buckets by name: blocks are added up in tasks, and make arrays of ``CONTEXTS`` numbers."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, alone = np.zeros(1 << BLOCK_BITS, np.int32), np.zeros(8, np.int64)
        for batch in batches:
            for at, n in zip(*(batch.column(i).to_pylist() for i in (2, 3))):
                if at is None:
                    alone += _array(n, np.int64)
                else:
                    total[_array(at, np.uint16)] += _array(n, np.int32)
        n = _bytes(alone if key[1].as_py() < 0 else total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([n])], ["name", "block", "n"])

    out: dict[str, np.ndarray] = {}
    for row in sums.select("name", "block", "at", "n").groupBy("name", "block").applyInArrow(_grouped(run), "name string, block int, n binary").toLocalIterator():
        if row.block < 0:
            out[row["name"]] = _array(row.n, np.int64)
        else:
            out.setdefault(row["name"], np.zeros(CONTEXTS, np.int32))[row.block << BLOCK_BITS : (row.block + 1) << BLOCK_BITS] = _array(row.n, np.int32)
    return out


def _totals(sums: dict[str, np.ndarray], before: Totals | None, dishes: np.ndarray | None) -> Totals:
    none = np.zeros(CONTEXTS, np.int32)
    words, shared, shared_tables, s1, s2, tokens, p1, p2 = sums.get("one", np.zeros(8, np.int64)).tolist()

    def discount(ones: int, twos: int) -> float:
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5

    if before is None:
        return Totals(sums.get("customers", none), sums.get("dishes", none), words, tokens, shared, shared_tables, (discount(p1, p2), discount(s1, s2)))
    return before._replace(tables=dishes + sums.get("more", none), shared_customers=shared, shared_tables=shared_tables)


ANSWERS = "chunk long, bucket int, counts binary, runs binary, score binary"


def _answered(fixed: DataFrame, state: DataFrame, kept_totals: list[Totals]) -> DataFrame:
    """For every chunk with pairs in a bucket: the words' training counts and the model's log 10 probabilities of the pairs."""
    first = kept_totals[0].customers  # the same in all
    sent = state.sparkSession.sparkContext.broadcast((first, [tuple(t._replace(customers=None)) for t in kept_totals]))
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("runs", pa.binary()), ("score", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, kept = sent.value[0], [Totals(*k) for k in sent.value[1]]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                runs, c, n = (_array(row[a], FIXED[a]) for a in ("runs", "contexts", "counts"))
                own, above = _array(row["own"], np.int32), [_array(x, np.int32) for x in row["kept"]]
                word_of = np.repeat(np.arange(len(runs)), runs)
                counts = np.bincount(word_of, n, len(runs)).astype(np.int32)
                mine = np.where(n > 0, n - kept[0].discounts[0], 0.0)
                mine[n > 1] = n[n > 1] - kept[0].discounts[0] * own / len(kept)
                p = np.zeros(len(c))
                for j, k in enumerate(kept):
                    spare = (STRENGTH[1] + k.discounts[1] * k.shared_tables) / (k.words + 1)
                    shared = (above[2 * j] - k.discounts[1] * above[2 * j + 1] + spare) / (STRENGTH[1] + k.shared_customers)
                    p += (mine + (STRENGTH[0] + k.discounts[0] * k.tables[c]) * shared[word_of]) / (STRENGTH[0] + customers[c])
                score = np.log10(p / len(kept)).astype(np.float32)
                for chunk, places in zip(row["chunks"], row["places"]):
                    at = np.cumsum(_array(places, np.int32))
                    words = word_of[at]
                    first = _starts(words)
                    told = (chunk, row["bucket"], _bytes(counts[words[first]]), _bytes(np.diff(np.r_[first, len(at)]).astype(np.int32)), _bytes(score[at]))
                    yield pa.RecordBatch.from_pylist([dict(zip(out.names, told))], out)

    both = fixed.select("bucket", "runs", "contexts", "counts", "chunks", "places").join(state.select("bucket", "own", "kept"), "bucket")
    return both.mapInArrow(run, ANSWERS)


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(chunk_docs: DataFrame, answers: DataFrame, t: Totals) -> DataFrame:
    """Each document's sums over its tokens."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    tokens, words = t.tokens, t.words

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        parts = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        counts = np.concatenate([np.repeat(_array(r["counts"], np.int32), _array(r["runs"], np.int32)) for r in parts])
        score = np.concatenate([_array(r["score"], np.float32) for r in parts])
        known, base = (counts > 0).astype(np.int64), np.log10((counts + 1.0) / (tokens + words + 1))
        tables = []
        for row in docs.to_pylist():
            steps, sizes = _array(row["words"], np.int32), np.array(row["sizes"], np.int64)
            first = np.cumsum(sizes) - sizes
            run_to = np.cumsum(steps, dtype=np.int64)
            at = run_to - np.repeat(run_to[first] - steps[first], sizes)
            sums = (np.add.reduceat(v[at], first) for v in (known, base, score.astype(np.float64)))
            tables.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(sizes), *map(pa.array, sums)], schema=out))
        return pa.concat_tables(tables) if tables else out.empty_table()

    return chunk_docs.select("chunk", "words", "ids", "sizes").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RESULT)


def _write(df: DataFrame, name: str, spark: SparkSession) -> str:
    """The path of ``df`` written by kind."""
    path = scratch(spark, name)
    with tidy(spark):
        df.write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
    return path


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, kept: int = KEPT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, learned from rows with ``train``."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1), F.lit(0))).first()[0]
    buckets = max(4, math.ceil(size / BUCKET_BYTES))
    path = _write(_chunks(docs, train, id_col, text_col, buckets), "chunks", spark)

    def kind(path: str, which: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path).filter(F.col("kind") == which)

    once = at = _write(_counted(kind(path, "pairs", CHUNKS).repartition(buckets, "bucket")), "state", spark)
    discard(spark, f"{path}/kind=pairs")
    totals = _totals(_summed_up(kind(at, "sums", STATE)), None, None)
    dishes, kept_totals = totals.tables, []
    for number in range(sweeps):
        keep = number >= sweeps - kept
        sent, old = spark.sparkContext.broadcast(tuple(totals._replace(customers=None))), at
        at = _write(_swept(kind(old, "state", STATE), sent, number, keep), "state", spark)
        totals = _totals(_summed_up(kind(at, "sums", STATE)), totals, dishes)
        kept_totals += [totals] * keep
        discard(spark, f"{old}/kind=state", f"{old}/kind=sums")
        sent.destroy()
    told = _write(_answered(kind(once, "fixed", STATE), kind(at, "state", STATE), kept_totals).withColumn("kind", F.lit("answers")), "answers", spark)
    discard(spark, once, at)
    done = _scored(kind(path, "docs", CHUNKS), spark.read.schema(ANSWERS).parquet(told), totals)
    return done.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
