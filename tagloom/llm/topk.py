"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(1024 x). Queries go to the executors in blocks of at
most ``BLOCK_VALUES`` values, one broadcast and one pass over the candidates for
each, so candidates stay where they are and are never shuffled.

A task reads its candidates in batches, in vertical layout: dimension blocks of
``DIMS`` values each. Scores are accumulated block by block; after each, the
Cauchy-Schwarz bound on the dimensions that remain discards candidates that cannot
reach the query's k-th score any more (ties stay), and the rest are compacted. The
k-th score known so far is the better of two: that of a sample of the candidates,
computed first and sent to all tasks with the queries, and that of the candidates
the task has met. Each task returns k rows a query at most; a ranked window keeps
the best k of those.

All arithmetic on scores is exact: in doubles where the largest sum stays below
2^53, in 64-bit integers below 2^62, else in Python's; a score among the k highest
that does not fit a long is an error.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part; an empty vector only meets empty ones, with score 0; vectors of different
lengths do not meet; every row is a candidate, also one that repeats another; a
query never meets its own id, rows that repeat a query are one query, and different
vectors that share a query's id are ranked together; rows without an id take no part;
a query without candidates gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

BLOCK_VALUES = 4_000_000
SAMPLE = 2048
ROWS = 8192
DIMS = 8
SCALE = 1024.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    x = F.col(vec_col).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != math.inf))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as doubles where they hold it, else as Python's integers."""
    if float(np.abs(x).max(initial=0)) < 2.0**1000:
        return np.floor(x * SCALE)  # a product with a power of two is exact
    return np.array([int(e) * 1024 if abs(e) > 2.0**53 else math.floor(e * SCALE) for e in x.ravel().tolist()], object).reshape(x.shape)


class Best:
    """The k best candidates of each query of a block, all of one length, as batches go by."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floors: list | None = None):
        self.queries, self.ids, self.k = integers(queries), ids, k
        self.floors = list(floors) if floors is not None else [None] * len(ids)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        self.most = float(np.abs(self.queries).max(initial=0))

    def meet(self, rows: np.ndarray, ids: np.ndarray) -> None:
        rows, d = integers(rows), self.queries.shape[1]
        most = float(np.abs(rows).max(initial=0)) * self.most * max(1, d)
        kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        cuts = list(range(0, d, DIMS))

        def exact(x: np.ndarray) -> np.ndarray:
            return np.array([int(e) for e in x.ravel().tolist()], object).reshape(x.shape) if kind is object else x.astype(kind)

        columns = [np.ascontiguousarray(exact(rows[:, c : c + DIMS]).T) for c in cuts]
        parts = [exact(self.queries[:, c : c + DIMS]) for c in cuts]
        rest, q_rest = ([np.sqrt((x[:, c + DIMS :].astype(np.float64) ** 2).sum(axis=1)) for c in cuts] for x in (rows, self.queries))
        for q, query_id in enumerate(self.ids):
            floor, live, score = self.floors[q], np.flatnonzero(ids != query_id), None
            for b in range(len(cuts)):
                c = columns[b] if len(live) == len(ids) else columns[b][:, live]
                score = parts[b][q] @ c if score is None else score + parts[b][q] @ c
                if floor is not None and b + 1 < len(cuts) and kind is not object:
                    keep = score + q_rest[b][q] * rest[b][live] * (1 + 1e-9) + 1 >= floor
                    live, score = live[keep], score[keep]
            if floor is not None and score is not None:
                keep = np.flatnonzero(score >= floor)
                live, score = live[keep], score[keep]
            if len(live):
                self._keep(q, ids[live], np.zeros(len(live)) if score is None else score)

    def _keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        old_ids, old = self.found[q]
        ids, score = np.concatenate([old_ids, ids]), np.concatenate([old, score])
        top = np.lexsort((ids, -score))[: self.k]
        self.found[q] = ids[top], score[top]
        if len(top) == self.k:
            least = score[top[-1]]
            self.floors[q] = least if self.floors[q] is None else max(self.floors[q], least)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query_id, (ids, score) in zip(self.ids.tolist(), self.found):
            for vec_id, s in zip(ids.tolist(), score.tolist()):
                yield query_id, vec_id, int(s)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries, sorted by length: of one length and a bounded size each."""
    ids, held, size = [], [], 0
    for row in queries.toLocalIterator():
        if held and (len(row.v) != len(held[0]) or size >= BLOCK_VALUES):
            yield np.array(ids, np.int64), np.array(held, float).reshape(len(ids), -1)
            ids, held, size = [], [], 0
        ids.append(row.vec_id)
        held.append(row.v)
        size += max(1, len(row.v))
    if held:
        yield np.array(ids, np.int64), np.array(held, float).reshape(len(ids), -1)


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the vectors of length d, in bounded pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column(1)
            fits = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == d)
            if len(fits):
                lists = lists.take(pa.array(fits))
                yield part.column(0).to_numpy(zero_copy_only=False)[fits], lists.flatten().to_numpy(zero_copy_only=False).reshape(len(fits), d)


LONG = 1 << 63


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products. ``is_query`` is a condition on vec_id."""
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vec_col)
    queries = rows.filter(is_query).distinct().sort(F.size("v"), "vec_id")
    found = []
    for query_ids, block in _blocks(queries):
        d = block.shape[1]
        sample = rows.filter(F.size("v") == d).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
        first = Best(block, query_ids, k)
        for ids, some in _matrices(iter(sample.combine_chunks().to_batches()), d):
            first.meet(some, ids)
        sent = spark.sparkContext.broadcast((query_ids, block, first.floors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, block, floors = sent.value
            best = Best(block, query_ids, k, floors)
            for ids, some in _matrices(batches, block.shape[1]):
                best.meet(some, ids)
            out = list(best.rows())
            if any(not -LONG <= s < LONG for _, _, s in out):
                raise OverflowError("a score among the highest does not fit a long")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

        found.append(written(rows.mapInArrow(run, "query_id long, vec_id long, score long"), "scores"))
        sent.destroy()
    if not found:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
