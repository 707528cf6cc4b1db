"""Spelling variant grouping by Aho-Corasick halves.

Words at one inserted, deleted or replaced code point share a half: of the shorter word
(either, if equally long), the first half stands at the beginning of the other word or the
second half at its end. Automaton shards hold every word's two halves; every word is scanned
by the shards that can hold a half of a near word, and a hit counts if the half stands at
the same distance from the beginning or the end, if the lengths fit, and if the words
are verified to differ by exactly one code point.

A half is a key: it names its shard, so a word visits three shards' keys and never all.
Halves of more than ``HOT`` words (short ones, common beginnings) are cut again: there
the halves of what is left of the word become part of the key, level by level, until no
key holds more. That loses no pair, as what is left differs in one place as well. So the
candidates of a word are bounded, whatever share of the words begins alike.

Words are counted in tasks before anything moves; forms are followed to the root by joins
whose steps double.

Defined cases: null and empty texts have no words; a null doc_id hashes as an empty one;
repeated rows count as often as they come; equal numbers go to the word smallest in
code-point order; a word without a near word has n_near 0 and is its own root; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_TIMES = 10  # a form is so many times as frequent
DELETE_EVERY = 31
HOT = 1024  # words of one half
LONG = 40  # what is left of a word beyond that is compared word by word
COUNTED = 200_000  # words a task counts before it hands them on
CHUNK = 20_000  # words in an automaton at once

#: Of Latin-1: letters A-Z lower-cased, a-z and from C0 on; all else separates.
_LETTER = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz" or i >= 0xC0 else ord(chr(i).lower()) if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for i in range(256))
_KEYED = "key string, word string, n long, lo int, hi int, owner boolean, size int"


def runs(text: str) -> list[bytes]:
    """The lower-cased runs of letters as Latin-1, a byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTER).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, at least ``LEAST_LENGTH`` long and ``LEAST_COUNT`` times."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs(text.as_py())).items():
                    if len(word) >= LEAST_LENGTH:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
                        if h % DELETE_EVERY == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def halves(word: str, lo: int, hi: int) -> list[tuple[str, int, int, bool]]:
    """The keys of ``word`` between lo and hi: (which half and its letters, what is left: lo and hi, own half).

    Its own halves, and those that a word one shorter would have.
    """
    found = {}
    for length in (hi - lo - 1, hi - lo):
        first, second = length // 2, length - length // 2
        found["<" + word[lo : lo + first]] = (lo + first, hi, length == hi - lo)
        found[">" + word[hi - second : hi]] = (lo, hi - second, length == hi - lo)
    return [(key, *rest) for key, rest in found.items()]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (key, word, n, lo, hi) under the keys of what is left of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f"{key}{half}", word, n, *rest, len(half) - 1) for key, word, n, lo, hi in zip(*(c.to_pylist() for c in batch.columns)) for half, *rest in halves(word, lo, hi)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], ["key", "word", "n", "lo", "hi", "owner", "size"])

    return rows.select("key", "word", "n", "lo", "hi").mapInArrow(run, _KEYED)


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, is one replaced or inserted code point away."""
    longer = len(b) - len(a)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i + 1 - longer :] == b[i + 1 :]
    return longer == 1


class Rests:
    """What is left of the words that own one half at one place: looked up whole, or with one place open."""

    def __init__(self) -> None:
        self.whole: dict[str, tuple[str, int]] = {}
        self.open: dict[str, list[tuple[str, int]]] = {}
        self.long: list[tuple[str, int]] = []

    def add(self, rest: str, word: str, n: int) -> None:
        if len(rest) > LONG:
            self.long.append((word, n))
            return
        self.whole[rest] = (word, n)
        for i in range(len(rest)):
            self.open.setdefault(f"{rest[:i]}*{rest[i + 1 :]}", []).append((word, n))

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """Words that may be near one with this rest."""
        if len(rest) <= LONG + 1:
            for i in range(len(rest)):
                if found := self.whole.get(rest[:i] + rest[i + 1 :]):
                    yield found
                if found := self.open.get(f"{rest[:i]}*{rest[i + 1 :]}"):
                    yield from found
        yield from self.long


class Shard:
    """An automaton over halves; of each the words it belongs to, by what stands before a first half's end or from a second half's beginning."""

    def __init__(self, owners: list[tuple[str, str, int, int, int, int]]):
        """``owners``: key, word, n, what is left of the word (lo and hi), the half's length."""
        self.automaton = ahocorasick.Automaton()
        held: dict[str, dict[tuple[bool, str], Rests]] = {}
        for key, word, n, lo, hi, size in owners:
            front = key[-size - 1] == "<"
            fixed, rest = (word[:lo], word[lo:]) if front else (word[hi:], word[:hi])
            held.setdefault(key[-size:], {}).setdefault((front, fixed), Rests()).add(rest, word, n)
        for half, places in held.items():
            self.automaton.add_word(half, (len(half), list(places.items())))
        self.automaton.make_automaton()

    def near(self, words: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
        """(word, its n, a near word, its n) of all ``words`` scanned: the first is the shorter, or if equally long the smaller."""
        for word, n in words.items() if len(self.automaton) else ():
            length = len(word)
            for end, (size, places) in self.automaton.iter(word):
                for (front, fixed), rests in places:
                    if front:
                        if len(fixed) != end + 1 or not word.startswith(fixed):
                            continue
                        rest = word[end + 1 :]
                    else:
                        if len(fixed) != length - end - 1 + size or not word.endswith(fixed):
                            continue
                        rest = word[: length - len(fixed)]
                    for other, m in rests.near(rest):
                        longer = length - len(other)
                        if (longer == 1 or (longer == 0 and other < word)) and one_edit(other, word):
                            yield other, m, word, n


def _pairs(keyed: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of near words that share a key, perhaps more than once."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        shard = Shard([r[:5] + (r[6],) for r in rows if r[5]])
        pairs = set(shard.near({r[1]: r[2] for r in rows}))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*pairs)) or [()] * 4, kinds)], ["a", "n_a", "b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:  # sorted by key, the words that own a half first: these stay until the key's last row
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= CHUNK:
                yield found(held)
                last = held[-1][0]
                held = [r for r in held if r[0] == last and r[5]]
        if held:
            yield found(held)

    dealt = keyed.repartition("key").sortWithinPartitions("key", F.desc("owner"))
    return dealt.mapInArrow(run, "a string, n_a long, b string, n_b long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all near pairs of ``words`` (word, n), either way."""
    start = words.select(F.lit("").alias("key"), "word", "n", F.lit(0).alias("lo"), F.length("word").alias("hi"))
    keyed, pairs = written(_keyed(start), "halves"), None
    while True:
        hot = written(keyed.filter("owner").groupBy("key", "size").count().filter((F.col("count") > HOT) & (F.col("size") >= 3)).select("key"), "hot-halves")
        found = _pairs(keyed.join(hot, "key", "left_anti").select("key", "word", "n", "lo", "hi", "owner", "size"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if hot.isEmpty():
            break
        keyed = written(_keyed(keyed.join(hot, "key", "left_semi")), "halves")
    one = written(pairs.distinct(), "near-words")
    return one.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        one.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Steps double, so that few joins suffice."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        joined = roots.join(onward, "root", "left")
        if joined.filter("_on IS NOT NULL").isEmpty():
            return roots
        roots = joined.select("word", F.coalesce("_on", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(word_counts(docs, id_col, text_col), "words")
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    kept = F.when(-F.col("b.m") >= FORM_TIMES * F.col("n"), F.col("b"))
    near = written(best.select("word", kept["near"].alias("form"), "n_near", (-kept["m"]).alias("form_n")), "nearest")
    roots = _roots(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
