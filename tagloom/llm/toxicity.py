"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon is a trie of terms, and of stems learned from labelled texts (a stem
fits every word that starts with it). A word's Levenshtein automaton of radius 1
walks down the trie, kept as two bit sets (places reached without and with one
edit). It ends in the terms it accepts, and in the stems that some beginning of the
word is within one edit of; digits and signs put for letters, and two letters that
changed places, also count as a misspelling. Words that share no half of a term or
stem where one edit leaves it cannot be within one edit and are not walked; results
are remembered for a bounded number of words. Terms and stems of ``FUZZY`` letters or
more are met with any edit, terms of four with letters that changed places or were
doubled. Words of clean labelled texts that are near a term or stem are no misspelling
of it; other words near it still are.

Each hit is weighed in a window of ``WINDOW`` words to both sides: address and
emphasis (you, are, !) count as abuse, quotation marks around it, reporting verbs
and meta words (said, called, "word", quote) as quotation. A document's signals
are its abusive and quoted hits of each kind, their density and which kinds there
are. A logistic regression, drawn to ``PRIOR`` where the labels say nothing, turns
them into a score. Stems, excluded words and weights are learned on a sample of at
most about ``SAMPLE`` labelled rows; nothing else is bounded.

Only the text is given to the score. Every word of every text is looked at, with
no shuffle.

Defined cases: a null or empty text has no hits and the score of any text without
hits; a label that is null is not learned; a document labelled twice counts as
toxic if one label says so; of several texts of one labelled id one is learned; with no labels or only one kind, the prior weights are
used; repeated rows are scored each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped, unpacked, written
from .linear import logistic

#: Insults and slurs of everyday use.
LEXICON = (
    "bastard", "bitch", "bollocks", "clown", "cretin", "disgusting", "dumb", "dumbass", "fool", "garbage", "idiot", "idiotic", "imbecile", "jerk",
    "loser", "lunatic", "moron", "moronic", "parasite", "pathetic", "pervert", "pigheaded", "repulsive", "retard", "scum", "scumbag", "sleazy",
    "stupid", "swine", "trash", "vermin", "vile", "wanker", "weirdo", "worthless",
)
#: Words that address someone, and words that report or discuss speech.
ADDRESS = ("you", "your", "you're", "ur", "u", "are", "is", "such", "absolute", "complete", "total", "shut", "go", "hate")
REPORT = ("said", "says", "say", "called", "calls", "wrote", "quote", "quoted", "quoting", "word", "words", "term", "terms", "insult", "insults", "according", "alleged", "allegedly", "reported", "shouted", "means", "meaning")

WINDOW = 6
THRESHOLD = 0.3
SAMPLE = 12_000
REMEMBERED = 300_000
MARKS = ".,;:!?\"'()[]{}<>|*#$%&…«»„“”‘’-–—"
QUOTES = "\"«»„“”‘’'"

KINDS = ("term", "misspelled", "stem", "misspelled_stem")
SIGNALS = (*(f"abusive_{k}" for k in KINDS), *(f"quoted_{k}" for k in KINDS), *(f"any_{k}" for k in KINDS), "density")
#: Weights without labels, in the order of SIGNALS, then the bias.
PRIOR = (2.0, 2.0, 1.0, 0.5, -1.0, -1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.5, 0.3, -2.5)

#: A learned stem: its letters, and the evidence (log likelihood ratio) and share of toxic documents it needs.
STEM_LETTERS = range(3, 9)
STEM_EVIDENCE = 15.0
STEM_SHARE = 0.6
FUZZY = 5
#: Signs put for letters.
SIGNS = str.maketrans("013457@$", "oieastas")


class Lexicon:
    def __init__(self, terms: tuple[str, ...] = LEXICON, stems: frozenset[str] = frozenset(), excluded: frozenset[str] = frozenset()):
        self.exact, self.stems, self.excluded = frozenset(terms), stems, excluded
        self.stem_sizes = sorted({len(t) for t in stems})
        self.letters = {"".join(sorted(t)) for t in terms if len(t) >= 4}
        self.short = {t[: i + 1] + t[i:] for t in terms if len(t) == 4 for i in range(4)}  # one letter doubled
        self.trie: dict = {}
        for end, words in (("", [t for t in terms if len(t) >= FUZZY]), ("stem", [t for t in stems if len(t) >= FUZZY])):
            for word in words:
                node = self.trie
                for c in word:
                    node = node.setdefault(c, {})
                node[end] = word
        #: (from the end, first place, letters): what one edit leaves whole of a term, by the word's length, and of a stem.
        self.halves: dict[int, set[tuple[int, str]]] = {}
        self.begins: set[tuple[int, str]] = set()
        for word in (t for t in terms if len(t) >= FUZZY):
            h = len(word) // 2
            for n in (len(word) - 1, len(word), len(word) + 1):
                self.halves.setdefault(n, set()).update(((0, word[:h]), (n - len(word) + h, word[h:])))
        for word in (t for t in stems if len(t) >= FUZZY):
            h = len(word) // 2
            self.begins.update(((0, word[:h]), *((h + move, word[h:]) for move in (-1, 0, 1))))
        self.places = {n: self._by_place(found) for n, found in self.halves.items()}
        self.begin_places = self._by_place(self.begins)

    @staticmethod
    def _by_place(found: set[tuple[int, str]]) -> list[tuple[int, int, frozenset[str]]]:
        """(first place, place after the last, the letters that may stand there)."""
        spans = sorted({(at, at + len(w)) for at, w in found})
        return [(low, high, frozenset(w for at, w in found if (at, at + len(w)) == (low, high))) for low, high in spans]

    def _possible(self, word: str) -> bool:
        """False only if no term and no stem is within one edit: an edit before the half's end leaves the rest whole, one after it the half."""
        return any(word[low:high] in s for low, high, s in self.places.get(len(word), ())) or any(word[low:high] in s for low, high, s in self.begin_places)

    def find(self, word: str) -> int:
        """0 if nothing fits, 1 for a term itself, 2 for a misspelling, 3 for a word with a learned stem, 4 with a misspelled one."""
        if word in self.exact:
            return 1
        if any(word[:n] in self.stems for n in self.stem_sizes):
            return 3
        if word in self.excluded:
            return 0
        plain = word if word.isalpha() else word.translate(SIGNS)
        if plain != word:
            if plain in self.exact:
                return 2
            if any(plain[:n] in self.stems for n in self.stem_sizes):
                return 4
        return self.nearest(plain)

    def nearest(self, word: str) -> int:
        """2 if a term is within one edit or one exchange of neighbours, else 4 if a stem is, else 0."""
        found = self._accepts(word) if self._possible(word) else 0
        if found == 2 or word in self.short:
            return 2
        if "".join(sorted(word)) in self.letters and any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] in self.exact for i in range(len(word) - 1)):
            return 2
        return found

    def _accepts(self, word: str) -> int:
        """Walk the trie with the word's automaton; bit i stands for i letters read."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        last, stack, found = 1 << len(word), [(self.trie, 1, 3)], 0
        while stack:
            node, none, one = stack.pop()
            for c, below in node.items():
                if c == "":
                    if one & last:
                        return 2
                elif c == "stem":
                    found = 4
                else:
                    at = places.get(c, 0)
                    exact = (none & at) << 1
                    edited = ((one & at) << 1 | none << 1 | none | exact << 1 | exact) & (2 * last - 1)
                    if edited:
                        stack.append((below, exact, edited))
        return found


class Finder(dict):
    """Words as they stand in a text -> what ``Lexicon.find`` says."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        found = self[word] = self.lexicon.find(word.strip(MARKS))
        return found


def abuse(words: list[str], at: int, hits: list[int]) -> float:
    """0 (quotation) to 1 (abuse) for the hit at ``at``, from the words around it."""
    word = words[at]
    around = [w.strip(MARKS) for w in words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]]
    score = 1.0 + 0.7 * sum(w in ADDRESS for w in around) + 0.7 * ("!" in word)
    score += 0.5 * sum(1 for i in range(max(0, at - WINDOW), min(len(words), at + WINDOW + 1)) if i != at and hits[i])
    score -= 1.5 * sum(w in REPORT for w in around)
    before = any(w[0] in QUOTES for w in words[max(0, at - WINDOW) : at + 1])
    after = any(w[-1] in QUOTES or w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in words[at : at + 1 + WINDOW])
    score -= 2.5 * (before and after)
    return 1 / (1 + np.exp(-score))


def signals_of(text: str | None, finder: Finder) -> tuple[float, ...]:
    words = (text or "").lower().split()
    hits = list(map(finder.__getitem__, words))
    kinds = len(KINDS)
    sums, seen = np.zeros(2 * kinds), np.zeros(kinds)
    if any(hits):
        for at, kind in enumerate(hits):
            if kind:
                share = abuse(words, at, hits)
                sums[kind - 1] += share
                sums[kind - 1 + kinds] += 1 - share
                seen[kind - 1] = 1
    return (*np.log1p(sums).tolist(), *seen.tolist(), float(np.log1p(100 * sums.sum() / max(1, len(words)))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def signals(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the columns ``SIGNALS``) of every document."""
    sent = shipped(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(unpacked(sent))
        for batch in batches:
            found = []
            for text in batch.column(1):
                if len(finder) > REMEMBERED:
                    finder.clear()
                found.append(signals_of(text.as_py(), finder))
            columns = zip(*found) if found else [()] * len(SIGNALS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *SIGNALS])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long" + "".join(f", {s} double" for s in SIGNALS))


class Toxicity(NamedTuple):
    lexicon: Lexicon
    weights: tuple[float, ...]


def _learned(labelled: DataFrame, terms: tuple[str, ...]) -> Lexicon:
    """The lexicon with the stems and exclusions that labelled texts (toxic, text) show."""
    plain = Lexicon(terms)
    sent = shipped(labelled.sparkSession, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = unpacked(sent), Counter()
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = {w.strip(MARKS) for w in (text or "").lower().split()}
                kinds = {w: lexicon.find(w) for w in words}
                stems = {w[:n] for w, kind in kinds.items() if not kind for n in STEM_LETTERS if len(w) >= n}
                near = {w for w, kind in kinds.items() if kind == 2}
                has_term = any(kind == 1 for kind in kinds.values())
                counts.update(("stem", x, toxic) for x in stems if not has_term)
                counts.update(("near", x, toxic) for x in near if not has_term)
                counts["all", "", toxic] += not has_term
            if len(counts) > 2_000_000:
                yield told(counts)
                counts.clear()
        yield told(counts)

    def told(counts: Counter) -> pa.RecordBatch:
        kind, word, toxic = zip(*counts) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(word, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["kind", "word", "toxic", "n"])

    counted = labelled.select("toxic", "text").mapInArrow(run, "kind string, word string, toxic int, n long")
    counted = counted.groupBy("kind", "word").agg(F.coalesce(F.sum(F.when(F.col("toxic") > 0, F.col("n"))), F.lit(0)).alias("bad"), F.sum("n").alias("n"))
    counted = counted.filter("kind <> 'stem' OR bad >= 5").cache()
    total = counted.filter("kind = 'all'").first()
    stems: set[str] = set()
    if total is not None and 0 < total.bad < total.n:
        base, p = total.bad / total.n, F.col("bad") / F.col("n")
        evidence = F.col("bad") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("bad")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
        good = counted.filter("kind = 'stem'").filter((p >= STEM_SHARE) & (evidence >= STEM_EVIDENCE))  # words of the sample
        for word in sorted((r.word for r in good.collect()), key=lambda w: (len(w), w)):
            if not any(word[:n] in stems for n in range(1, len(word))):
                stems.add(word)
    misled = {r.word for r in counted.filter("kind = 'near' AND 2 * bad < n").collect()}
    counted.unpersist()
    return Lexicon(terms, frozenset(stems), frozenset(misled))


def _misled(labelled: DataFrame, lexicon: Lexicon) -> Lexicon:
    """``lexicon`` without the words near its stems that are mostly in clean texts without any other hit."""
    sent = shipped(labelled.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, found = unpacked(sent), []
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                kinds = {w: lexicon.find(w) for w in {w.strip(MARKS) for w in (text or "").lower().split()}}
                if not any(kind in (1, 2, 3) for kind in kinds.values()):
                    found += [(w, toxic) for w, kind in kinds.items() if kind == 4]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())], ["word", "toxic"])

    near = labelled.select("toxic", "text").mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("bad"))
    return Lexicon(tuple(lexicon.exact), lexicon.stems, lexicon.excluded | {r.word for r in near.filter("2 * bad < n").collect()})


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, terms: tuple[str, ...] = LEXICON) -> Toxicity:
    """Learn from about ``sample`` of the labelled rows with ``train`` (a condition on doc_id)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    texts = _texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = written(texts.repartition("doc_id"), "labelled")
    lexicon = _misled(chosen, _learned(chosen, terms))
    rows = signals(chosen, lexicon).join(chosen.select("doc_id", "toxic"), "doc_id").drop("doc_id").collect()
    y = np.array([r.toxic for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Toxicity(lexicon, PRIOR)
    x = np.array([[*(r[s] for s in SIGNALS), 1.0] for r in rows])
    return Toxicity(lexicon, tuple(logistic(x, (y > 0).astype(float), reg=3 / len(y), prior=np.array(PRIOR)).tolist()))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, the signals) of every document."""
    found = signals(docs, model.lexicon, id_col, text_col)
    total = F.lit(float(model.weights[-1]))
    for name, w in zip(SIGNALS, model.weights):
        total = total + F.col(name) * F.lit(float(w))
    found = found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return found.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *SIGNALS)
