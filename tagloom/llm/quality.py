"""Quality by importance resampling of hashed n-grams.

Two bag-of-n-grams models over ``BINS`` hash bins of words and word pairs: one of
target text (documents labelled good), one of all raw text. A document's log
weight is the sum of log(target share / raw share) over its n-grams. Adding
Gumbel noise, drawn from a hash of doc_id, and keeping the k largest keys samples
k documents without replacement in proportion to their weights.

The raw model counts every n-gram of every document, partial sums first: each task
sends ``BINS`` sums. The target model counts the documents among a bounded sample
of at most about ``SAMPLE`` labelled ids. The k-th largest key is found by
histograms that close in on it, never by a sort of all rows.

Defined cases: a null or empty text has no n-grams and log weight 0; exactly the
share of documents asked for is kept (rounded up), of equal keys those with the
smaller doc_id, null last; without good labels all log weights are 0 and the
sample is uniform; a null doc_id draws its noise as one id; repeated rows draw the
same noise, and as many of them are kept as there is room for; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = 15
BINS = 1 << BITS
SAMPLE = 50_000
SEED = 11
REMEMBERED = 300_000
STEPS = 4096  # bins of one closing-in histogram


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


def ngram_bins(texts: list[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(bins of all n-grams, text by text; numbers of them)."""
    if len(known) > REMEMBERED:
        known.clear()
    bins, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        h = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        pairs = h[:-1] * np.uint32(0x85EBCA6B) + h[1:] * np.uint32(0xC2B2AE35)
        bins += [h, pairs]
        sizes[i] = len(h) + len(pairs)
    flat = np.concatenate(bins) if bins else np.empty(0, np.uint32)
    return ((flat * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), sizes


def log_ratios(docs: DataFrame, good: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of each bin; ``good`` has the sorted target ids."""
    sent = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target = WordHashes(), np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bins, sizes = ngram_bins(part.column(1).cast(pa.large_binary()).to_pylist(), known)
                raw += np.bincount(bins, minlength=BINS)
                ids = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = np.repeat(np.isin(ids, sent.value) & np.asarray(part.column(0).is_valid()), sizes)
                target += np.bincount(bins[hit], minlength=BINS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bin", "raw", "target"])

    sums = docs.select("doc_id", "text").mapInArrow(run, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BINS), np.ones(BINS)
    for row in sums.collect():  # BINS rows at most
        raw[row.bin] += row.raw
        target[row.bin] += row.target
    if target.sum() == BINS:
        return np.zeros(BINS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(keyed: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column without nulls."""
    low, high = keyed.agg(F.min(key), F.max(key)).first()
    while low < high:
        inside = keyed.filter((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / STEPS
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(STEPS - 1)).cast("int") if low + width > low else (F.col(key) > low).cast("int")
        counts = np.zeros(STEPS, np.int64)
        lows, highs = {}, {}
        for row in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("l"), F.max(key).alias("h")).collect():
            counts[row["at"]], lows[row["at"]], highs[row["at"]] = row.n, row.l, row.h
        upward = np.cumsum(counts[::-1])[::-1]
        found = int(np.flatnonzero(upward >= k)[-1])
        k -= int(upward[found] - counts[found])
        low, high = lows[found], highs[found]
    return low


def largest(keyed: DataFrame, key: str, k: int) -> DataFrame:
    """``keyed`` (a written table) with ``selected``: exactly the k largest, of equal keys those with the smaller doc_id.

    Rows alike in key and doc_id are numbered by their place in the table, each task
    for itself after the rows of the tasks before it.
    """
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    least = kth_largest(keyed, key, k)
    wanted = k - keyed.filter(F.col(key) > least).count()
    tied = keyed.filter(F.col(key) == least)
    for row in tied.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("doc_id")).toLocalIterator():  # as a rule one
        last, left = row.doc_id, wanted
        wanted -= row.n
        if wanted <= 0:
            break
    first = F.coalesce(F.col("doc_id") < F.lit(last), F.lit(False)) if last is not None else F.col("doc_id").isNotNull()
    alike = F.col("doc_id").eqNullSafe(F.lit(last).cast("long"))
    place = F.monotonically_increasing_id()
    split = 1 << 33  # above it, the task
    marked = keyed.withColumn("_tied", (F.col(key) == least) & alike)
    if wanted == 0:
        return marked.withColumn("selected", (F.col(key) > least) | ((F.col(key) == least) & (first | alike))).drop("_tied")
    numbered = marked.filter("_tied").withColumn("_at", place)
    before, counts = 0, {}
    for row in numbered.groupBy(F.floor(F.col("_at") / split).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():  # a row per task
        counts[row.task] = max(0, min(row.n, left - before))
        before += row.n
    some = F.create_map(*[F.lit(x) for task, n in counts.items() for x in (task, n)])
    taken = numbered.withColumn("selected", F.col("_at") % split < some[F.floor(F.col("_at") / split)]).drop("_at")
    rest = marked.filter("NOT _tied").withColumn("selected", (F.col(key) > least) | ((F.col(key) == least) & first))
    return rest.unionByName(taken).drop("_tied")


def importance(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected) of every document.

    ``share``: of the documents to keep; if None, the share of good ones among the labels.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_good, n_all = marked.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    if share is None:
        share = n_good / n_all if n_all else 1.0
    chosen = marked.filter((F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n_good)) * (1 << 30)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    good = np.sort(np.array([r.doc_id for r in chosen.select("doc_id").collect()], np.int64))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(rows, good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bins, sizes = ngram_bins(part.column(1).cast(pa.large_binary()).to_pylist(), known)
                weights = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ratios.value[bins], len(sizes)).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(weights)], ["doc_id", "n_features", "log_weight"])

    weighed = rows.mapInArrow(run, "doc_id long, n_features long, log_weight double")
    even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = written(weighed.withColumn("gumbel_key", F.col("log_weight") - F.ln(-F.ln(even))), "weights")
    k = math.ceil(share * keyed.count())
    return largest(keyed, "gumbel_key", k)
