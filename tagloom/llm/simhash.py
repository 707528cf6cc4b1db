"""SimHash near duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles. Fingerprints link at ``LINK_BITS`` (4) or fewer differing bits;
a document's component is the smallest doc_id that links reach.

Candidate keys. The fingerprint is cut into segments A, B, C of 21, 21 and 22
bits, each seen as a word of the perfect binary Golay code (23 bits, radius 3).
A segment's indices are those of all codewords within distance 4: one to six.
Two words at distance 2 or less always share such an index, as the patterns of
weight 3 and 4 in a coset of leader weight 3 partition all 23 places. Four
differing bits fall on the segments in one of two ways:

* some segment X has none: then another, Y, has at most 2, and the pair meets
  on (X, index of Y);
* each has at least one: then two segments, X and Y, have exactly one and the
  third, Z, at most 2. One half of X and one half of Y are equal, and the pair
  meets on (half of X, half of Y, index of Z).

So every pair within 4 bits shares a key, and all that meet are verified.

``one_of_each`` asks for similar shingles rather than for four bits. There fingerprints are
looked up by two of three segments' indices, which finds most pairs with many more bits between
them. Each text's nearest by the bits is verified on the shingles themselves, which joins most copies;
the exact join of ``jaccard`` then finds every link between texts that this has not joined.

Work grows with distinct fingerprints, not copies: equal fingerprints become one
node first. In a key's group a breadth-first walk keeps a spanning forest of the
verified links, so a group of m fingerprints gives fewer than m links when it is
large. Components come from alternating star contractions, written to the shared
folder in each round.

Defined cases: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle hash as one; repeated rows come out
as often as they came in; a null doc_id is kept and links like any other, and is no
component's id unless all its members are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, passing, written

LINK_BITS = 4
SEED = 42  # of XXH64
SHINGLES_AT_ONCE = 1 << 16
SIMILARITY = 0.8
NEAR_BITS = 15  # at that similarity two fingerprints differ in 9 or 10 on average
HOT_ROWS = 100_000  # rows of one fingerprint that go to one task
PAIRED = 16  # groups up to this size are compared pair by pair, larger ones walked

#: Fixed value: the Golay code's generator x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: First bit and width of the segments A, B, C.
SEGMENTS = ((43, 21), (22, 21), (0, 22))


def _shingles(text: bytes, words: int) -> Iterator[bytes]:
    found = text.lower().split()
    if len(found) < words:
        return iter([b" ".join(found)] if found else [])
    return map(b" ".join, zip(*(found[i:] for i in range(words))))


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles, by splitmix64's mixing; number 0 leaves them."""
    if not number:
        return hashes
    x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, words: int, number: int = 1) -> tuple[int, ...]:
    """``number`` fingerprints: the majority of the hashes' bits, 1 where set in over half of them."""
    import xxhash

    digest, total, ones, part = xxhash.xxh64_digest, 0, np.zeros((number, 64), np.int64), []

    def count(part: list[bytes]) -> np.ndarray:
        hashes = np.frombuffer(b"".join(part), ">u8").astype(np.uint64)
        bits = (np.unpackbits(_mixed(hashes, i).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) for i in range(number))
        return np.stack([b.sum(axis=0, dtype=np.int64) for b in bits])

    for shingle in _shingles(text, words):
        part.append(digest(shingle, SEED))
        if len(part) == SHINGLES_AT_ONCE:
            ones, total, part = ones + count(part), total + len(part), []
    if part:
        ones, total = ones + count(part), total + len(part)
    return tuple(int.from_bytes(np.packbits(2 * o > total).tobytes(), "big") for o in ones)


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), number: int = 1) -> DataFrame:
    """(doc_id, fp, the long columns ``carry``), with further fingerprints as fp1, fp2 ...: their bits as longs."""
    names = ["fp", *(f"fp{i}" for i in range(1, number))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", words, number) for t in texts], np.uint64).reshape(-1, number).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(number)), *batch.columns[2:]], ["doc_id", *names, *carry])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return one.mapInArrow(run, "doc_id long" + "".join(f", {c} long" for c in (*names, *carry)))


def golay_indices() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes, the error patterns of weight 4 or less: (patterns padded with -1, their numbers)."""
    syndromes = np.array([_syndromes(np.array([1 << i]))[0] for i in range(23)])
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            found[int(np.bitwise_xor.reduce(syndromes[list(bits)])) if bits else 0].append(sum(1 << b for b in bits))
    out = np.full((2048, max(map(len, found))), -1, np.int64)
    for s, patterns in enumerate(found):
        out[s, : len(patterns)] = patterns
    return out, (out >= 0).sum(axis=1)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


def golay_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) for all keys of the fingerprints."""
    fps = fps.view(np.uint64)
    segments = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    indices = []  # of each segment: positions and codeword indices
    for words in segments:
        errors = patterns[_syndromes(words)]
        at, which = np.nonzero(errors >= 0)
        indices.append((at, (words[at] ^ errors[at, which]) >> 11))
    rows, keys, tag = [], [], 0
    for y in range(3):
        at, index = indices[y]
        for x in range(3):
            if x != y:
                rows.append(at)
                keys.append((tag << 40) | (segments[x][at] << 12) | index)
                tag += 1
        one, two = (s for s in range(3) if s != y)
        for shift_one, shift_two in ((0, 0), (0, 11), (11, 0), (11, 11)):
            rows.append(at)
            keys.append((tag << 40) | (((segments[one][at] >> shift_one) & 2047) << 24) | (((segments[two][at] >> shift_two) & 2047) << 12) | index)
            tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def pair_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key): two segments' indices each. Fingerprints meet where two segments share an index."""
    fps = fps.view(np.uint64)
    found = []
    for low, width in SEGMENTS:
        words = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        errors = patterns[_syndromes(words)]
        found.append(np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1))
    rows, keys = [], []
    for tag, (x, y) in enumerate(combinations(range(3), 2)):
        both = (found[x][:, :, None] >= 0) & (found[y][:, None, :] >= 0)
        at, i, j = np.nonzero(both)
        rows.append(at)
        keys.append((tag << 24) | (found[x][at, i] << 12) | found[y][at, j])
    return np.concatenate(rows), np.concatenate(keys)


def _near(a: np.ndarray, b: np.ndarray, bits: int = LINK_BITS) -> np.ndarray:
    """Whether fingerprints differ in ``bits`` or fewer; several of a document stand in columns."""
    differ = np.bitwise_count(a ^ b)
    return (differ if differ.ndim == 1 else differ.sum(axis=1)) <= bits


def _walk(fps: np.ndarray, bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints, breadth first from the first."""
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(fps[left], fps[at], bits)
            for other in left[near]:
                links.append((at, other))
            queue.extend(left[near])
            left = left[~near]
    return links


def _central(fps: np.ndarray) -> np.ndarray:
    """Rows by their distance from the majority of all rows' bits: first what most others are copies of."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    return np.argsort((bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(fps))).sum(axis=1), kind="stable")


def _group_pairs(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Near rows with equal keys, by position; ``keys`` is sorted. Large groups are walked from their middle."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[start, len(keys)])
    small, found = np.repeat(sizes <= PAIRED, sizes), [np.empty((0, 2), np.int64)]
    for gap in range(1, int(sizes[sizes <= PAIRED].max(initial=1))):
        i = np.flatnonzero((keys[gap:] == keys[:-gap]) & small[gap:])
        i = i[_near(fps[i], fps[i + gap], bits)]
        found.append(np.stack([i, i + gap], axis=1))
    for s, n in zip(start[sizes > PAIRED], sizes[sizes > PAIRED]):
        order = s + _central(fps[s : s + n])
        if pairs := _walk(fps[order], bits):
            found.append(order[np.array(pairs)])
    return np.concatenate(found)


def group_links(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, bits: int = LINK_BITS) -> np.ndarray:
    """Links (id, smaller id) among rows with equal keys; ``keys`` is sorted. In a large group they are a spanning forest, so what it joins is what all links would join."""
    out = ids[_group_pairs(keys, fps, bits)]
    out = out[out[:, 0] != out[:, 1]]
    return np.unique(np.stack([out.max(axis=1), out.min(axis=1)], axis=1), axis=0)


def group_nearest(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, d): of each id that is near others its nearest, as far as the groups were compared, and the bits between them."""
    at = _group_pairs(keys, fps, bits)
    at = np.concatenate([at, at[:, ::-1]])
    x, y, d = ids[at[:, 0]], ids[at[:, 1]], np.bitwise_count(fps[at[:, 0]] ^ fps[at[:, 1]]).astype(np.int64)
    order = np.lexsort((y, d, x))
    order = order[x[order] != y[order]]
    order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
    return x[order], y[order], d[order]


def _met(keyed: DataFrame, find, schema: str) -> DataFrame:
    """``find(keys, fps, ids)`` over whole groups of rows (key, id, fp) that share a key; it returns the columns of ``schema``."""

    def found(parts: list[pa.RecordBatch], end: int) -> pa.RecordBatch:
        """What whole groups give: ``parts`` in order, of the last one ``end`` rows."""
        parts = [*parts[:-1], parts[-1].slice(0, end)]
        keys, ids, fps = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in find(keys, fps.view(np.uint64), ids)], [c.split()[0] for c in schema.split(", ")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by key: the last group may go on in the next batch
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (len(held) > 1 and held[-2].column(0)[-1].as_py() != keys[-1]):
                yield found(held, cut)
                held = [batch.slice(cut)]
        if held:
            yield found(held, held[-1].num_rows)

    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(verify, schema)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with b < a: verified links among the distinct fingerprints of ``nodes`` (fp)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, _ = golay_indices()
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                fps = part.column(0).to_numpy(zero_copy_only=False)
                rows, keys = golay_keys(fps, patterns)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "id"])

    keyed = nodes.select("fp").mapInArrow(emit, "key long, id long")
    return _met(keyed.select("key", "id", F.col("id").alias("fp")), lambda *group: group_links(*group).T, "a long, b long").distinct()


def nearest(nodes: DataFrame) -> DataFrame:
    """(x, y): of each node (id, fp) that meets one within ``NEAR_BITS`` the nearest; a row a node at most, however many it meets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, _ = golay_indices()
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                rows, keys = pair_keys(part.column(1).to_numpy(zero_copy_only=False), patterns)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(pa.array(rows)) for c in part.columns)], ["key", "id", "fp"])

    keyed = nodes.select("id", "fp").mapInArrow(emit, "key long, id long, fp long")
    met = _met(keyed, lambda *group: group_nearest(*group, NEAR_BITS), "x long, y long, d long")
    return met.groupBy("x").agg(F.min_by("y", "d").alias("y"))


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums over their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's component, for ids that have links.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    round only aggregates by node and joins by node, and ends as stars.
    """
    edges = written(edges.select("a", "b"), "links")
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        after = written(small.filter(F.col("a") != F.col("b")).distinct(), "stars")
        if (now := _digest(after)) == before:
            return after.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        edges, before = after, now


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, root, n): each fingerprint's component, named by one of its fingerprints, and its number of rows."""
    nodes = written(marked.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    roots = components(links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")


def _spread(marked: DataFrame, classes: DataFrame, *what: str) -> DataFrame:
    """``marked`` with the columns ``what`` of its fingerprint; rows of a hot fingerprint go to many tasks."""
    hot = classes.filter(F.col("n") > HOT_ROWS).select("fp", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_pieces"))
    piece = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.coalesce("_pieces", F.lit(1)))
    left = marked.join(F.broadcast(hot), "fp", "left").withColumn("_piece", piece.cast("int")).drop("_pieces")  # a row per HOT_ROWS documents at most
    last = F.greatest(F.ceil(F.col("n") / HOT_ROWS), F.lit(1)).cast("int") - 1
    return left.join(classes.select("fp", *what, F.explode(F.sequence(F.lit(0), last)).alias("_piece")), ["fp", "_piece"]).drop("_piece")


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(_classes(marked), "classes")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("id")).join(classes, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    return _spread(marked, classes.join(least, "root"), "component_id").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest doc_id, of those the one whose text's hash is least.

    Texts are near copies if ``least`` of their distinct shingles' union is in both, or by
    way of others. Each text's nearest by fingerprint is compared first, then, by the exact join of ``jaccard``,
    whatever shares a rare shingle and is not joined yet, so no link is lost. Rows are told
    apart by doc_id and text, so different texts of one doc_id are different documents.
    Rows that repeat both leave one. A null doc_id loses to any other.
    """
    from .jaccard import text_components

    hashes = [F.xxhash64(F.lit(i), F.col(text_col).cast("string")) for i in (1, 2)]
    keyed = docs.select(F.struct(*(F.col(c).alias(f"h{i}") for i, c in enumerate(docs.columns))).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(h.alias(f"k{i}") for i, h in enumerate(hashes)))
    with narrow(docs.sparkSession), passing(docs.sparkSession):  # what follows reads the verdict only
        marked = written(fingerprints(keyed, words, carry=("k0", "k1")), "fingerprints")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")
        nodes = written(marked.groupBy(F.col("k0").alias("id")).agg(F.min("fp").alias("fp"), F.min(order).alias("m")), "nodes")
        near = written(nearest(nodes), "nearest")
        roots = text_components(keyed.select("doc_id", "text", F.col("k0").alias("k")), words, round(100 * least), near).withColumnRenamed("k", "id")
        best = nodes.join(roots, "id").groupBy("root").agg(F.min("m").alias("m")).select("m.doc_id", "m.k0", "m.k1")
        repeated = marked.groupBy("doc_id", "k0", "k1").agg(F.count("*").alias("n"))
        stays = (F.col("_b.doc_id").eqNullSafe(F.col("_r.doc_id"))) & (F.col("_b.k0") == F.col("_r.k0")) & (F.col("_b.k1") == F.col("_r.k1"))
        judged = written(repeated.alias("_r").join(best.alias("_b"), stays, "left").select("_r.doc_id", "_r.k0", "_r.k1", F.col("_b.k0").isNotNull().alias("kept"), "n"), "judged", keep=True)

    def those(left: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        """``left`` with or without the documents of ``rows``."""
        rows = rows.select(F.col("doc_id").alias("_d"), F.col("k0").alias("_k0"), F.col("k1").alias("_k1"))
        return left.join(rows, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1")), how)

    # What goes and what is repeated is less than what stays: most documents are not shuffled where that is small.
    single = those(keyed, judged.filter("NOT kept OR n > 1"), "left_anti").select("_row")
    several = those(keyed, judged.filter("kept AND n > 1"), "left_semi").groupBy("doc_id", "k0", "k1").agg(F.first("_row").alias("_row")).select("_row")
    return single.unionByName(several).select(*(F.col(f"_row.h{i}").alias(c) for i, c in enumerate(docs.columns)))
