"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring tokens: marked places count, the others
are ignored, so a hit survives substituted tokens. The masks are four of five
tokens, whichever is left out: of a stretch with at most a fifth of its places
changed, cut into fives, one five has at most one change, so every overlap of five
tokens or more has a seed in common. Seeds of texts and of items are joined by
their hash; a text and an item that share one are verified.

An overlap is a stretch on one diagonal (place in the text minus place in the item)
with at least ``MIN_SIMILARITY`` of its tokens equal, places compared one by one. A
document is contaminated if an overlap has ``MIN_MATCHES`` equal tokens, or its equal
tokens are ``MIN_SIMILARITY`` of an item of at least five tokens. Equal tokens are
first counted by diagonal, and only diagonals with enough of them, and more than the
best overlap so far, are cut into stretches: a much repeated token costs one count
per pair of places, never a row.

As a Spark job. The benchmark's tokens and seeds are made in tasks and written. A
table of ``2^FILTER_BITS`` bits at most, set where a seed's hash falls, tells texts
which of their seeds to send to the join. Texts are told apart by two 64-bit hashes,
so copies are verified once. The smaller side of a join is broadcast up to
``MAX_BROADCAST`` bytes, else dealt out ``SALTS`` times, so that a seed, item or text
that is very common goes to many tasks.

Tokens are lower-cased words without punctuation at their ends.

Defined cases: null and empty texts are clean; items that are null, empty or of
fewer than five tokens are ignored; of several items the one with the most equal
tokens is reported, ties to the smaller item_id, and none for clean documents;
repeated documents are judged each for itself; an empty benchmark leaves all
documents clean; other columns are ignored, or handed through by ``clean``, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed masks: all of five words but one, the first or last for the first mask.
MASKS = ("1111", "10111", "11011", "11101")
MIN_SIMILARITY = 0.8
MIN_MATCHES = 10
MIN_TOKENS = 5
FILTER_BITS = 28
MAX_BROADCAST = 64 << 20  # bytes
SALTS = 16
ITEMS_AT_ONCE = 64
PAIRS_AT_ONCE = 1 << 21
REMEMBERED = 300_000

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&…«»„“”‘’¿¡-–—"


def tokens(text: str | None) -> list[str]:
    return [w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if w]


class Codes(dict):
    """Words as they stand in a text -> a 64-bit hash of the token, 0 where punctuation is all."""

    def __missing__(self, word: str) -> int:
        import xxhash

        token = word.strip(PUNCTUATION)
        code = self[word] = xxhash.xxh64_intdigest(token) or 1 if token else 0
        return code

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = (text or "").lower().split()
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return codes[codes != 0]


def seeds(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes by place) of each mask."""
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(5)]
    for number, mask in enumerate(MASKS):
        n = max(0, len(codes) - len(mask) + 1)
        out = np.full(n, number * 0x632BE59BD9B4E019 % 2**64, np.uint64)
        for i, m in enumerate(mask):
            if m == "1":
                out += codes[i : i + n] * odd[i]
        yield len(mask), out


def overlap(same: np.ndarray) -> int:
    """Equal tokens of the best stretch of a diagonal on which at least four of five are equal."""
    total = np.r_[0, np.cumsum(np.where(same, 1, -4))]  # rises or stays over a stretch with four of five equal
    count = np.r_[0, np.cumsum(same)]
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)  # the first place from which it does
    return int((count - count[begin]).max())


def best_overlap(text: np.ndarray, item: np.ndarray) -> int:
    """Equal tokens of the best overlap that makes a text contaminated, 0 without one.

    Equal pairs are counted by diagonal, ``PAIRS_AT_ONCE`` at a time, so memory grows with the lengths and not with their product.
    """
    n, m = len(text), len(item)
    least = min(MIN_MATCHES, -(-4 * m // 5))
    order = np.argsort(item, kind="stable")
    ordered, best = item[order], 0
    low, high = np.searchsorted(ordered, text, "left"), np.searchsorted(ordered, text, "right")
    counts = high - low
    hit = np.flatnonzero(counts)
    ends = np.cumsum(counts[hit])
    totals, at = np.zeros(n + m, np.int64), 0  # of each diagonal: where the item would begin, counted from 1 - m
    while at < len(hit):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        some, each = hit[at:to], counts[hit[at:to]]
        inside = np.arange(ends[to - 1] - done) - np.repeat(ends[at:to] - each - done, each)
        diagonals = np.repeat(some, each) - order[np.repeat(low[some], each) + inside] + m - 1
        first = int(diagonals.min())
        found = np.bincount(diagonals - first)
        totals[first : first + len(found)] += found
        at = to
    some = np.flatnonzero(totals >= max(1, least))
    for diagonal in some[np.argsort(-totals[some], kind="stable")]:
        if totals[diagonal] <= best or best == m:
            break
        begin = int(diagonal) - m + 1
        low_, high_ = max(0, begin), min(n, begin + m)
        best = max(best, overlap(text[low_:high_] == item[low_ - begin : high_ - begin]))
    return best if best >= least else 0


def _size(df: DataFrame) -> int:
    """Bytes of the rows, about."""
    each = [F.size(c) * 8 if t.startswith("array") else F.octet_length(c) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    return df.agg(F.sum(sum((F.coalesce(e, F.lit(0)).cast("long") for e in each), F.lit(0)))).first()[0] or 0


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the written table ``right``, whatever key is common in ``left``."""
    if _size(right) <= MAX_BROADCAST:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, codes): item is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in batches:
            codes = [known.of(t.as_py()).view(np.int64) for t in batch.column(1)]
            some = [i for i, c in enumerate(codes) if len(c) >= MIN_TOKENS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([codes[i] for i in some], pa.list_(pa.int64()))], ["item_id", "codes"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    return written(rows.mapInArrow(run, "item_id long, codes array<long>").select(F.monotonically_increasing_id().alias("item"), "item_id", "codes"), "items")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, codes in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                found = np.unique(np.concatenate([h for _, h in seeds(np.array(codes, np.int64).view(np.uint64))])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), item))], ["seed", "item"])

    return written(items.select("item", "codes").mapInArrow(run, "seed long, item long"), "seeds")


def _filter(item_seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(shift, bytes): a table of bits, set at the seeds' hashes shifted right."""
    distinct = item_seeds.select("seed").distinct()
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(max(2, distinct.count()))) + 10))
    at = F.shiftrightunsigned("seed", 64 - bits)
    words = distinct.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int").bitwiseAND(63))).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return 64 - bits, out.view(np.uint8)


def _text_seeds(texts: DataFrame, shift: int, table: np.ndarray) -> DataFrame:
    """(k0, k1, seed) of texts (k0, k1, text): the seeds that the filter knows."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Codes(), sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                each = [known.of(t.as_py()) for t in part.column(2)]
                ends, codes = np.cumsum([len(c) for c in each]), np.concatenate(each)
                docs, found = [], []
                for length, hashes in seeds(codes):
                    at = hashes >> np.uint64(shift)
                    hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    doc = np.searchsorted(ends, hit, "right")
                    inside = hit + length <= ends[doc]
                    docs.append(doc[inside])
                    found.append(hashes[hit[inside]])
                pairs = np.unique(np.rec.fromarrays([np.concatenate(docs), np.concatenate(found)], names="doc,seed"))
                doc = pa.array(pairs.doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(pairs.seed.view(np.int64))], ["k0", "k1", "seed"])

    return texts.mapInArrow(run, "k0 long, k1 long, seed long")


def _verified(rows: DataFrame) -> DataFrame:
    """(k0, k1, item_id, equal_tokens, item_share) of rows (k0, k1, text, items): the best item of each row that is contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in batches:
            found = []
            for k0, k1, text, items in zip(*batch.columns):
                codes, best = known.of(text.as_py()), None
                for item in items.as_py():
                    there = np.array(item["codes"], np.int64).view(np.uint64)
                    if n := best_overlap(codes, there):
                        best = max(best, (n, -item["item_id"], len(there))) if best else (n, -item["item_id"], len(there))
                if best:
                    found.append((k0.as_py(), k1.as_py(), -best[1], best[0], best[0] / best[2]))
            if found:
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["k0", "k1", "item_id", "equal_tokens", "item_share"])

    return rows.mapInArrow(run, "k0 long, k1 long, item_id long, equal_tokens int, item_share double")


def _findings(docs: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """(k0, k1, item_id, equal_tokens, item_share): one row per contaminated text, by its hashes."""
    items = _items(benchmark, "item_id", "text")
    item_seeds = _item_seeds(items)
    texts = _keyed(docs, text_col).select("k0", "k1", F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    shared = _beside(_text_seeds(texts, *_filter(item_seeds)), item_seeds, ["seed"])
    pairs = written(shared.select("k0", "k1", "item").distinct(), "candidates")
    several = written(pairs.groupBy("k0", "k1").agg(F.count("*").alias("n")), "texts")
    chosen = _beside(texts, several.select("k0", "k1"), ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.first("text").alias("text"))
    asked = _beside(pairs, items, ["item"]).join(several, ["k0", "k1"])
    piece = F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / ITEMS_AT_ONCE)).alias("piece")
    lists = asked.groupBy("k0", "k1", piece).agg(F.collect_list(F.struct("item_id", "codes")).alias("items"))
    rows = lists.join(chosen, ["k0", "k1"]).select("k0", "k1", "text", "items")
    best = F.max_by(F.struct("item_id", "equal_tokens", "item_share"), F.struct("equal_tokens", -F.col("item_id"))).alias("b")
    return written(_verified(rows).groupBy("k0", "k1").agg(best).select("k0", "k1", "b.*"), "findings")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with two hashes of the text, k0 and k1."""
    return docs.select("*", *(F.xxhash64(F.lit(i + 1), F.col(text_col).cast("string")).alias(f"k{i}") for i in (0, 1)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_id, equal_tokens, item_share) of every document: whether it holds benchmark text, and of which item the most."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judged = _beside(_keyed(docs, "text").select("doc_id", "k0", "k1"), _findings(docs, benchmark, "text"), ["k0", "k1"], "left")
    return judged.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("equal_tokens", F.lit(0)).alias("equal_tokens"), F.coalesce("item_share", F.lit(0.0)).alias("item_share"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    rows = docs.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(docs.columns)), F.col(text_col).alias("text"))
    left = _beside(_keyed(rows, "text").drop("text"), _findings(rows, benchmark, "text").select("k0", "k1"), ["k0", "k1"], "left_anti")
    return left.select(*(F.col(f"_h{i}").alias(c) for i, c in enumerate(docs.columns)))
