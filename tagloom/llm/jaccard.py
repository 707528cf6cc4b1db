"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles; two link when ``PERCENT`` of their
union is in both. Shingles are ordered from rare to common; two sets that link share one
of the first of that order (the prefix).

* Equal sets become one class, classes of equal prefix and size one group. Only groups
  are dealt out by the shingles of their prefixes, and only shingles that two groups share go on.
* First every group is compared with a few others a shingle, that whose prefix is shared most and ``HUBS`` drawn
  by their hash, and every class with one other of its group; where sizes and bitmaps allow it, links are verified
  on whole sets. This joins most of what belongs together at a few comparisons each, however large a group of near copies is.
* Then, where groups that share a shingle are not yet joined, they are expanded to their classes, and pairs of those
  in different components are filtered by size, by the shingle's place, and by bitmaps of whole sets, which show how
  much two sets differ at least. What is left is verified. So no link between components is lost and no pair within one is made.

The order comes from counts in ``BUCKETS`` hashed buckets, rounded to powers of two, then the hash: a
shingle of many documents comes late, so that a passage that is everywhere makes no large group.
Any order gives the same result. What is broadcast has a fixed size: a byte a bucket.

Hashes are 64 bits for shingles (compared within pairs of documents) and 128 bits for sets.
Components come from the star contractions of ``simhash.components``.

Defined cases: null and empty texts, or such without a word, have an empty set, n_shingles 0 and
themselves as component; texts with fewer words than a shingle are one shingle as a whole; repeated rows come out as
often as they came in; a null doc_id is kept and links like any other, and names no
component unless all its members are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .simhash import components

WORDS = 3
PERCENT = 90
BUCKETS = 1 << 24
SLICES = 64  # parts of the buckets that are summed apart
HELD = 1 << 22  # bucket numbers that a task holds before it counts them
BITS = 1024  # of a set's bitmap
HUBS = 2  # groups drawn for a shingle, that all others are compared with first

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    found = (text or b"").lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(found))] if found else [], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    h = np.full(n, words, np.uint64)
    for i in range(words):  # as the places differ, so do the hashes of the same words in another order
        h = (h ^ one[i : i + n]) * _ODD[i % 3]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(n, m, percent: int = PERCENT):
    """Of sets of these sizes, so that they link: the least whole number."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """Shingles of the prefix: sets that link share one of them, whichever is larger."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int = PERCENT):
    """As ``prefix_length``, for the smaller set of a pair."""
    return n - least_overlap(n, n, percent) + 1


def parities(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as longs: which buckets hold an odd number of the set. Two sets differ in as many shingles as bits, or more."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _slices(buckets: np.ndarray) -> pa.RecordBatch:
    """How often each bucket occurs: a row a slice that has any, made one at a time. Sorts ``buckets``."""
    buckets.sort()
    size, rows, parts = BUCKETS // SLICES, [], []
    ends = np.searchsorted(buckets, np.arange(SLICES + 1) * size)
    for i in np.flatnonzero(np.diff(ends)):
        counts = np.bincount(buckets[ends[i] : ends[i + 1]] - np.uint32(i * size), minlength=size).astype(np.uint32)
        rows.append(i)
        parts.append(pa.compress(counts.tobytes(), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])


def _levels(counted: DataFrame) -> Broadcast:
    """Bit lengths of the buckets' sums over all tasks, a byte each, sent out compressed; ``_unpacked`` gives them. Whoever asks for them destroys them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(pa.decompress(counts.as_py(), 4 * BUCKETS // SLICES, codec="zstd"), np.uint32).astype(np.int64)
                sums[i] = sums[i] + one if i in sums else one
        levels = [pa.compress(np.frexp(s.astype(float))[1].astype(np.uint8).tobytes(), codec="zstd", asbytes=True) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])

    out = {r["slice"]: bytes(r["levels"]) for r in counted.repartition(SLICES, "slice").mapInArrow(run, "slice int, levels binary").collect()}  # BUCKETS bytes at most
    return counted.sparkSession.sparkContext.broadcast(out)


def _unpacked(levels: Broadcast) -> np.ndarray:
    size, out = BUCKETS // SLICES, np.zeros(BUCKETS, np.uint8)
    for i, part in levels.value.items():
        out[i * size : (i + 1) * size] = np.frombuffer(pa.decompress(part, size, codec="zstd"), np.uint8)
    return out


def _tallied(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket. A task holds ``HELD`` bucket numbers at most, not a count for each of ``BUCKETS``."""
    held, n = np.empty(HELD, np.uint32), 0
    for hashes in batches:
        for part in (hashes[i : i + HELD] for i in range(0, len(hashes), HELD)):
            if n + len(part) > HELD:
                yield _slices(held[:n])
                n = 0
            held[n : n + len(part)] = part % np.uint64(BUCKETS)
            n += len(part)
    if n:
        yield _slices(held[:n])


def _whole(texts: list[bytes], words: int) -> np.ndarray:
    sets = [shingles(t, words) for t in texts]
    return np.concatenate(sets) if sets else np.empty(0, np.uint64)


def _shingle_levels(docs: DataFrame, words: int) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (batch.column(0).cast(pa.large_binary()) for batch in batches)
        parts = (column.slice(i, 256) for column in texts for i in range(0, len(column), 256))
        yield from _tallied(_whole([t.as_py() for t in part], words) for part in parts)

    return _levels(docs.select("text").mapInArrow(run, "slice int, counts binary"))


def _signatures(docs: DataFrame, words: int, levels: Broadcast, percent: int = PERCENT) -> DataFrame:
    """Of each document: its set's size, 128-bit hash and bitmap, its prefix, and the hash of its size and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = _unpacked(levels)
        for batch in batches:
            sizes, sets, groups, prefixes, maps = [], [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                one = shingles(text.as_py(), words)
                n = len(one)
                order = level[(one % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | one >> np.uint64(8)
                first = np.sort(order)[: prefix_length(n, percent) if n else 0]
                sizes.append(n)
                sets.append(xxhash.xxh3_128_digest(one.tobytes()))
                groups.append(xxhash.xxh3_128_digest(first.tobytes() + n.to_bytes(8, "big")))
                prefixes.append(first.view(np.int64))
                maps.append(parities(one))
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
            words_of = pa.ListArray.from_arrays(pa.array(np.arange(0, len(maps) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(maps) if maps else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()), lists, words_of], ["doc_id", "k", "n", "set", "grp", "prefix", "bits"])

    return docs.select("doc_id", "text", "k").mapInArrow(run, "doc_id long, k long, n long, set binary, grp binary, prefix array<long>, bits array<long>")


def _sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(set, shingles) of the classes ``wanted`` (set, k), from one text each.

    Texts whose hash ``k`` falls into no wanted bucket are passed over before anything moves.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tallied(batch.column(0).to_numpy().view(np.uint64) for batch in batches)

    some = _levels(wanted.select("k").mapInArrow(tally, "slice int, counts binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, done = _unpacked(some), set()
        for batch in batches:
            k = batch.column(1).to_numpy().view(np.uint64)
            sets, hashes = [], []
            for i in np.flatnonzero(level[(k % np.uint64(BUCKETS)).astype(np.int64)]):
                text = batch.column(0)[int(i)].as_py()
                one = shingles(None if text is None else text.encode(), words).tobytes()
                digest = xxhash.xxh3_128_digest(one)
                if digest not in done:
                    done = done if len(done) < 1 << 16 else set()
                    done.add(digest)
                    sets.append(digest)
                    hashes.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(hashes, pa.binary())], ["set", "shingles"])

    found = docs.select("text", "k").mapInArrow(run, "set binary, shingles binary")
    sets = written(found.join(wanted.select("set"), "set", "left_semi").groupBy("set").agg(F.first("shingles").alias("shingles")), "sets")
    some.destroy()
    return sets


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets link. Only sets that stand in a pair are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    sets = _sets(docs, words, written(classes.select("set", "k").join(ends, "set", "left_semi"), "wanted"))
    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _ordered(one: str | Column, other: str | Column) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and bitmaps let them link."""
    x, y = (classes.select(F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    least, smaller = least_overlap_of(F.col("a_n"), F.col("b_n"), percent), F.least("a_n", "b_n")
    sized = pairs.join(x, "a").join(y, "b").filter(smaller - (F.col("a_n") == F.col("b_n")).cast("int") >= least)
    return sized.filter(differ <= F.col("a_n") + F.col("b_n") - 2 * least).select("a", "b")


def class_pairs(rows: list[tuple], only_last: int = 0, percent: int = PERCENT) -> list[tuple]:
    """Pairs of classes of one shingle that may hold links not known yet.

    ``rows``: (class, size, whether the shingle stands where the smaller set's must, component, bitmap), by size.
    Pairs with a second class among the last ``only_last`` rows (0: all).
    """
    sizes = np.array([r[1] for r in rows], np.int64)
    index = np.array([r[2] for r in rows], bool)
    _, roots = np.unique(np.array([r[3] for r in rows], object), return_inverse=True)
    bits = np.stack([np.asarray(r[4], np.int64) for r in rows]).view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
    out = []
    if (roots == roots[0]).all():
        return out
    for j in range(len(rows) - only_last if only_last else 1, len(rows)):
        lo = int(np.searchsorted(100 * sizes[:j], percent * sizes[j]))
        some = lo + np.flatnonzero((roots[lo:j] != roots[j]) & (index[lo:j] | ((sizes[lo:j] == sizes[j]) & index[j])))
        least = least_overlap(sizes[some], sizes[j], percent)
        fit = sizes[some] - (sizes[some] == sizes[j]) >= least  # equal sizes and all in common would be one class
        some, least = some[fit], least[fit]
        if len(some):
            differ = np.bitwise_count(bits[some] ^ bits[j]).sum(axis=1, dtype=np.int64)
            out += [(rows[i][0], rows[j][0]) for i in some[differ <= sizes[some] + sizes[j] - 2 * least]]
    return out


def _candidates(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of classes that share a shingle and pass the filters. A task holds a shingle's groups of similar size at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        fresh, key = 0, None

        def settle() -> list[tuple]:
            nonlocal held, fresh
            pairs = class_pairs(held, min(fresh, len(held)), percent) if len(held) > 1 and fresh else []
            fresh = 0
            if held:
                held = [r for r in held if r[1] * 100 >= percent * held[-1][1]]  # rows come by size
            return pairs

        for batch in batches:
            pairs = []
            maps = batch.column(5)
            for i, (k, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if k != key:
                    pairs += settle()
                    held, key = [], k
                held.append((*row, maps[i].values.to_numpy()))
                fresh += 1
                if fresh >= 1024:
                    pairs += settle()
            yield _pairs_batch(pairs)
        yield _pairs_batch(settle())

    dealt = rows.select("key", "set", "n", "index", "root", "bits").repartition("key").sortWithinPartitions("key", "n", "set")
    return dealt.mapInArrow(run, "a binary, b binary").select(*_ordered("a", "b")).distinct()


def _pairs_batch(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in set(pairs)], pa.binary()) for i in range(2)] if pairs else [pa.array([], pa.binary())] * 2, ["a", "b"])


def _components(marked: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int = PERCENT, near: DataFrame | None = None) -> DataFrame:
    """(set, root) of the classes that link with others. ``near`` (a, b): further pairs of classes to compare first.

    Where shingles meet, groups go by 64 bits of their hash: two that share them are both looked at.
    """
    hubs = classes.groupBy("grp").agg(F.min("set").alias("hub"), F.count("*").alias("members"))
    prefixes = marked.filter("n > 0").groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    keyed = prefixes.select(F.xxhash64("grp").alias("g"), "n", F.posexplode("prefix").alias("at", "key")).select("key", "g", "n", (F.col("at") < index_length_of(F.col("n"), percent)).alias("index"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.max("index").alias("any")).filter((F.col("m") > 1) & F.col("any")).select("key", "m")
    meeting = written(keyed.join(shared, "key"), "shared-shingles")
    groups = written(hubs.join(classes.select(F.col("set").alias("hub"), "n"), "hub").withColumn("g", F.xxhash64("grp")), "groups")
    share = meeting.groupBy("g", "n").agg((F.sum("m") / prefix_length_of(F.col("n"), percent)).alias("s")).drop("n")
    drawn = [F.max(F.struct(F.xxhash64("g", F.lit(i)).alias("s"), "g"))["g"] for i in range(HUBS)]
    central = meeting.select("key", "g").join(share, "g").groupBy("key").agg(F.max(F.struct("s", "g"))["g"].alias("h"), *(h.alias(f"h{i}") for i, h in enumerate(drawn)))
    central = central.select("key", F.explode(F.array_distinct(F.array("h", *(f"h{i}" for i in range(HUBS))))).alias("other"))
    stars = meeting.select("key", "g").join(central, "key").filter(F.col("g") != F.col("other")).select(F.least("g", "other").alias("g"), F.greatest("g", "other").alias("other")).distinct()
    ends = groups.select(F.col("g").alias("other"), F.col("hub").alias("_hub"))
    between = stars.join(ends, "other").join(groups.select("g", "hub"), "g").select(*_ordered("hub", "_hub"))
    several = groups.filter((F.col("members") > 1) & (F.col("n") - 1 >= least_overlap_of(F.col("n"), F.col("n"), percent)))
    within = classes.join(several.select("grp", "hub"), "grp").filter(F.col("set") != F.col("hub")).select(*_ordered("set", "hub"))
    tried = between.unionByName(within) if near is None else between.unionByName(within).unionByName(near).distinct()
    first = written(_linked(written(_plausible(tried, classes, percent), "first-pairs"), classes, docs, words, percent), "links")
    named = written(classes.select("set", F.xxhash64("grp").alias("g"), "n", "bits").join(components(first).withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")), "joined")

    # What is left: shingles of classes not all joined, and groups of one class that are not.
    inside = named.groupBy("g").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    placed = meeting.select("key", "g", "index").join(inside, "g")
    open_keys = placed.groupBy("key").agg((F.min("least") != F.max("most")).alias("open")).filter("open").select("key")
    members = named.select("g", "set", "n", "root", "bits")
    more = placed.join(open_keys, "key").select("key", "g", "index").join(members, "g").select("key", "set", "n", "index", "root", "bits")
    apart = several.join(inside.filter(F.col("least") != F.col("most")), "g", "left_semi").select("g")
    same = members.join(apart, "g", "left_semi").select(F.col("g").alias("key"), "set", "n", F.lit(True).alias("index"), "root", "bits")
    pairs = written(_candidates(more.unionByName(same), percent), "more-pairs")
    return components(first.unionByName(written(_linked(pairs, classes, docs, words, percent), "links")))


def least_overlap_of(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """``least_overlap``, as a column."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def prefix_length_of(n: Column, percent: int = PERCENT) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def index_length_of(n: Column, percent: int = PERCENT) -> Column:
    return n - least_overlap_of(n, n, percent) + 1


def _marked(one: DataFrame, words: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures of documents (doc_id, text, k), and the classes of those that have a word."""
    levels = _shingle_levels(one, words)
    marked = written(_signatures(one, words, levels, percent), "signatures")
    levels.destroy()
    return marked, written(marked.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("id"), F.min("k").alias("k"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("bits").alias("bits")), "classes")


def text_components(one: DataFrame, words: int, percent: int, near: DataFrame) -> DataFrame:
    """(k, root) of the texts of ``one`` (doc_id, text, k), k being the text's hash: texts of one root link, or by way of others.

    ``near`` (x, y): pairs of k to compare first. They save comparisons; every link is found without them.
    Here texts without a word are one class.
    """
    marked, classes = _marked(one, words, percent)
    of = written(marked.groupBy("k").agg(F.first("set").alias("set")), "sets-of-texts")
    x, y = (of.select(F.col("k").alias(c), F.col("set").alias(f"_{c}")) for c in ("x", "y"))
    first = near.join(x, "x").join(y, "y").filter(F.col("_x") != F.col("_y")).select(*_ordered("_x", "_y"))
    roots = _components(marked, classes, one, words, percent, first)
    return of.join(roots.withColumnRenamed("id", "set"), "set", "left").select("k", F.coalesce("root", "set").alias("root"))


def jaccard_components(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("k"))
    marked, classes = _marked(one, words)
    roots = _components(marked, classes, one, words)
    named = classes.select("set", "id").join(roots.withColumnRenamed("id", "set"), "set", "left").select("set", "id", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    found = marked.select("doc_id", "n", "set").join(named.join(least, "root").select("set", "component_id"), "set", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
