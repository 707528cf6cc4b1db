"""Ranked lexical search by block-max pruning.

Documents, in their table's order, are cut into ranges of ``BLOCK`` documents. A
block is a small forward index: each document's query terms with their impacts, and
beside them every term's largest impact in the block. A query's bound for a block is
the sum of its terms' weights times those maxima. Each task sorts its blocks by bound
and scores them, document by document, until the bound drops below the tenth best
score so far; a block whose bound equals that score is still read, as a smaller doc_id
wins a tie. Tasks do not begin from nothing: for each query the ``SEEDS`` blocks of
largest bound anywhere are scored first, and their tenth best score is a floor for all.

The index holds the terms of the stated queries. Queries come in blocks of about
``QUERY_BYTES`` of text, each with a vocabulary that is broadcast, weights included, so
any number of queries works in bounded memory. Documents are read in tasks and never
shuffled; what moves is each task's best few per query. Scores are 64-bit integers.

Defined cases: null and empty texts, or such without a term, are no documents and no
queries (an item without a term has no row); repeated documents rank each for itself,
equal rows in any order; repeated items (same id and text) rank once, different texts
of one item_id each for itself; a null doc_id comes after all others of its score and
is reported as null; a null item_id is an item like any other; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shipped, unpacked, written

BLOCK = 64  # documents
SORTED = 512  # blocks whose bounds a task sorts at once
SEEDS = 3  # blocks a query whose scores make its floor
QUERY_BYTES = 8 << 20
LENGTH_SHARE = 75  # percent of a document's length that counts, Okapi's b
SCALE, SATURATION = 1_000_000_000, 8

#: ASCII letters and digits stay, A-Z lower-cased; bytes from 128 on stay; all else separates.
_TERM = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))

_INDEX = "block long, documents long, terms long, ids array<long>, lengths array<long>, ends array<int>, places array<int>, times array<int>, held array<int>, words array<int>"
_BLOCKS = "block long, ids array<long>, ends array<int>, places array<int>, impacts array<int>, words array<int>, maxima array<int>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


class Queries:
    """A block of queries: of each its terms' numbers in the vocabulary and how often it has them."""

    def __init__(self, rows: list[Row]):
        self.vocabulary: dict[bytes, int] = {}
        self.items, numbers, times, starts = [], [], [], []
        for row in rows:
            counts = Counter(terms((row["text"] or "").encode()))
            if counts:
                self.items.append(row["item_id"])
                starts.append(len(numbers))
                numbers += [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts]
                times += counts.values()
        self.numbers, self.times, self.starts = np.array(numbers, np.int64), np.array(times, np.int64), np.array(starts, np.int64)
        self.factors = self.times  # times each term's weight, once that is known

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        weights = np.zeros(len(self.vocabulary), np.int64)
        for term, n in holding.items():
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
        self.factors = self.times * weights[self.numbers]

    def of(self, query: int) -> slice:
        return slice(self.starts[query], self.starts[query + 1] if query + 1 < len(self.starts) else len(self.numbers))

    def bounds(self, words: np.ndarray, maxima: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Of every query, over one block. ``dense`` is as long as the vocabulary, zero before and after."""
        dense[words] = maxima
        out = np.add.reduceat(dense[self.numbers] * self.factors, self.starts)
        dense[words] = 0
        return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _index(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """A row per block of documents that follow each other: how often each has the queries' terms."""
    sent = shipped(docs.sparkSession, queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = unpacked(sent).get
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                documents = total = 0
                ids, lengths, found = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary())):
                    words = terms(text.as_py() or b"")
                    documents, total = documents + bool(words), total + len(words)
                    counts = Counter(map(number, words))
                    counts.pop(None, None)
                    if counts:
                        ids.append(i)
                        lengths.append(len(words))
                        found.append(counts)
                if documents:
                    numbers = np.array([n for c in found for n in c], np.int64)
                    words, places = np.unique(numbers, return_inverse=True)
                    arrays = (lengths, np.cumsum([len(c) for c in found]), places, [t for c in found for t in c.values()], np.bincount(places, minlength=len(words)), words)
                    kinds = (pa.int64(), *[pa.int32()] * 5)
                    lists = (pa.array([v if isinstance(v, list) else v.tolist()], pa.list_(k)) for v, k in zip(arrays, kinds))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (block, documents, total)), pa.array([ids], pa.list_(pa.int64())), *lists], ["block", "documents", "terms", "ids", "lengths", "ends", "places", "times", "held", "words"])
                    block += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


def _weighted(index: DataFrame, documents: int, total: int) -> DataFrame:
    """The index with impacts for counts, and each term's largest impact in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            impacts, maxima = [], []
            for lengths, ends, places, times, words in zip(*(batch.column(c) for c in ("lengths", "ends", "places", "times", "words"))):
                one = [100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total for n in lengths.as_py()]  # Python's integers: no product overflows
                ends, places, times = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ends, places, times))
                norm = np.repeat(np.array([min(m, 1 << 58) for m in one], np.int64), np.diff(ends, prepend=0))
                impact = SCALE * times // (1000 * times + SATURATION * norm)
                most = np.zeros(len(words.values), np.int64)
                np.maximum.at(most, places, impact)
                impacts.append(impact)
                maxima.append(most)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "ids", "ends", "places")), _lists(impacts, pa.int32()), batch.column("words"), _lists(maxima, pa.int32())], ["block", "ids", "ends", "places", "impacts", "words", "maxima"])

    some = index.filter(F.size("words") > 0).select("block", "ids", "lengths", "ends", "places", "times", "words")
    return some.mapInArrow(run, _BLOCKS)


def _best_blocks(blocks: DataFrame, queries: Queries) -> DataFrame:
    """(query, block): the ``SEEDS`` blocks of each query with the largest bounds."""
    sent = shipped(blocks.sparkSession, queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unpacked(sent)
        dense = np.zeros(len(q.vocabulary), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in q.items]
        for batch in batches:
            for block, words, maxima in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                bounds = q.bounds(words.values.to_numpy(), maxima.values.to_numpy(), dense)
                for i in np.flatnonzero(bounds):
                    (heapq.heappush if len(best[i]) < SEEDS else heapq.heappushpop)(best[i], (int(bounds[i]), block))
        rows = [(i, bound, block) for i, found in enumerate(best) for bound, block in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query", "bound", "block"])

    found = blocks.select("block", "words", "maxima").mapInArrow(run, "query long, bound long, block long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SEEDS).select("query", "block")


def _scored(blocks: DataFrame, queries: Queries, k: int, floors: dict[int, int], only: dict[int, list[int]] | None = None) -> DataFrame:
    """(query, doc_id, score): each task's best ``k`` documents of every query that reach its floor.

    ``only`` names the queries for which a block is to be scored; without it the bounds decide.
    """
    sent = shipped(blocks.sparkSession, (queries, floors, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floors, only = unpacked(sent)
        dense = np.zeros(len(q.vocabulary), np.int64)
        least = np.array([max(1, floors.get(i, 1)) for i in range(len(q.items))], np.int64)  # a score that may still matter
        best: list[list[tuple[int, bool, int]]] = [[] for _ in q.items]

        def score(query: int, block: tuple) -> None:
            ids, starts, places, impacts, words = block
            own = q.of(query)
            dense[q.numbers[own]] = q.factors[own]
            scores = np.add.reduceat(dense[words][places] * impacts, starts)
            dense[q.numbers[own]] = 0
            if len(some := np.flatnonzero(scores >= least[query])):
                found = [(-int(scores[d]), ids[d] is None, ids[d] or 0) for d in some]
                best[query] = heapq.nsmallest(k, best[query] + found)
                if len(best[query]) == k:
                    least[query] = max(least[query], -best[query][-1][0])

        def settle(held: list[tuple[int, np.ndarray, tuple]]) -> None:
            if not held:
                return
            if only is not None:
                for number, _, block in held:
                    for query in only.get(number, ()):
                        score(query, block)
                return
            bounds = np.stack([b for _, b, _ in held])
            for query in np.flatnonzero((bounds >= least).any(axis=0)):
                for at in np.argsort(-bounds[:, query], kind="stable"):
                    if bounds[at, query] < least[query]:
                        break
                    score(query, held[at][2])

        held: list[tuple[int, np.ndarray, tuple]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ends, places, impacts, words, maxima = (row[c].values.to_numpy() for c in ("ends", "places", "impacts", "words", "maxima"))
                block = (row["ids"].as_py(), np.r_[0, ends[:-1]], places, impacts.astype(np.int64), words)
                held.append((row["block"].as_py(), q.bounds(words, maxima, dense) if only is None else least, block))
                if len(held) == SORTED:
                    settle(held)
                    held = []
        settle(held)
        rows = [(i, None if none else d, -s) for i, found in enumerate(best) for s, none, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query", "doc_id", "score"])

    some = blocks.filter(F.col("block").isin(list(only))) if only is not None else blocks
    return some.mapInArrow(run, "query long, doc_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame | None:
    index = written(_index(docs, queries, id_col, text_col), "forward-index")
    totals = index.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    if not totals["n"]:
        return None
    holding = index.select(F.explode(F.arrays_zip("words", "held")).alias("t")).groupBy("t.words").agg(F.sum("t.held").alias("n"))
    queries.weigh(totals["n"], {r["words"]: r["n"] for r in holding.collect()})  # a row per term of this block of queries
    blocks = written(_weighted(index, totals["n"], totals["l"]), "block-maxima")
    only: dict[int, list[int]] = {}
    for r in _best_blocks(blocks, queries).collect():  # SEEDS a query
        only.setdefault(r["block"], []).append(r["query"])
    floors = {}
    if only:
        reached = _first(_scored(blocks, queries, k, {}, only), k).filter(F.col("rank") == k)
        floors = {r["query"]: r["score"] for r in reached.collect()}
    return _first(_scored(blocks, queries, k, floors), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // QUERY_BYTES)
    if parts > 1:
        asked = written(asked.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "queries")
    out = None
    for part in range(parts):
        queries = Queries((asked.filter(F.col("_part") == part) if parts > 1 else asked).collect())
        found = _search(docs, queries, k, id_col, text_col) if queries.items else None
        if found is not None:
            names = spark.createDataFrame(list(enumerate(queries.items)), "query long, item_id long")
            one = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row per query of this block
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
