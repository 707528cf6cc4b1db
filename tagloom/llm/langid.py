"""Language identification by hierarchical discrimination.

A text becomes counts of its lower-cased letters' 1-, 2- and 3-grams (with word
ends) hashed to ``FEATURES`` bins, square-rooted and scaled to length one. Linear
support vector machines first tell the language family, one family against
another; within the family, one-versus-one machines separate its languages.
Pairwise margins become probabilities by a logistic, and are summed over opponents
to find the winner. The score is the family's probability against its closest
opponent times the language's against its closest in the family: it can reach 1
however many languages there are, and is about 0.25 at most for a guess among both.

The machines are fitted on the driver on at most ``PER_LANG`` labelled rows
a language (chosen by a hash of doc_id and text), those of families on ``PER_FAMILY`` rows a
family: that sample is the only bounded part. The whole texts of the sample are
counted in Spark tasks; the driver gets the bins that are not empty and their counts,
and spreads them out for one machine at a time.
Prediction reads every whole text, needs no shuffle, and is given only the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null language is never learned; with one learned language all other texts get it
with score 1; with none, all are ``und``; languages without an entry in ``FAMILY``
are families of their own; repeated rows are predicted each for itself; an empty
table gives an empty result; other columns are ignored, or handed through by
``keep_identified``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shipped, unpacked
from .linear import svm

BITS = 13
FEATURES = 1 << BITS
PER_LANG = 600
PER_FAMILY = 1200
SPREAD = 256  # rows of the sample spread out at once

#: Families by ISO 639-1 code.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
}

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def counted(text: str) -> np.ndarray:
    """How often a whole text has n-grams of each bin."""
    a = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    a = a[keep]
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(257) + a[2:]
    out = np.zeros(FEATURES, np.int64)
    for n, grams in enumerate((a, two, three)):
        bins = ((grams + np.uint32(n * 7919)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out += np.bincount(bins, minlength=FEATURES)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length one."""
    out = np.sqrt(counts)
    return out / (np.linalg.norm(out) or 1.0)


class Rows:
    """Rows of features, only the bins that are not empty: (bins, counts) each."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def spread(self, some: np.ndarray) -> np.ndarray:
        """With a last column of ones, the bias."""
        out = np.zeros((len(some), FEATURES + 1))
        out[:, -1] = 1
        for one, i in zip(out, some.tolist()):
            bins, counts = self.rows[i]
            one[bins] = scaled(counts)
        return out

    def products(self, some: np.ndarray) -> np.ndarray:
        """Inner products of rows, spread out ``SPREAD`` at a time."""
        pieces = np.split(np.arange(len(some)), range(SPREAD, len(some), SPREAD))
        out = np.empty((len(some), len(some)))
        for i, p in enumerate(pieces):
            one = self.spread(some[p])
            for q in pieces[i:]:
                part = one @ (one if q is p else self.spread(some[q])).T
                out[np.ix_(p, q)], out[np.ix_(q, p)] = part, part.T
        return out

    def combined(self, some: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The sum of rows, each as often as ``parts`` says."""
        out = np.zeros(FEATURES + 1)
        for at in range(0, len(some), SPREAD):
            out += parts[at : at + SPREAD] @ self.spread(some[at : at + SPREAD])
        return out


class Hierarchy:
    """Families, then languages, each by one-versus-one machines."""

    def __init__(self, x: Rows, langs: list[str]):
        family = np.array([FAMILY.get(lang, lang) for lang in langs])
        langs = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(langs[family == f].tolist())) for f in self.families}
        place = np.zeros(len(langs), np.int64)  # in its language, so that a family's rows are from all its languages
        for lang in set(langs.tolist()):
            place[langs == lang] = np.arange((langs == lang).sum())
        order = np.argsort(place, kind="stable")
        few = np.sort(np.concatenate([order[family[order] == f][:PER_FAMILY] for f in self.families]))
        self.top = self._machines(x, family, self.families, few)
        self.within = {f: self._machines(x, langs, m, np.flatnonzero(family == f)) for f, m in self.members.items()}

    @staticmethod
    def _machines(x: Rows, y: np.ndarray, names: list[str], rows: np.ndarray) -> np.ndarray:
        pairs = list(combinations(names, 2))
        out = np.zeros((len(pairs), FEATURES + 1))
        for i, (a, b) in enumerate(pairs):
            some = rows[(y[rows] == a) | (y[rows] == b)]
            out[i] = x.combined(some, svm(x.products(some), np.where(y[some] == a, 1.0, -1.0)))
        return out

    @staticmethod
    def _votes(machines: np.ndarray, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row, and its probability against its closest opponent."""
        votes, least = np.zeros((len(x), n)), np.ones((len(x), n))
        wins = 1 / (1 + np.exp(-np.clip(4 * (x @ machines[:, :-1].T + machines[:, -1]), -30, 30)))
        for i, (a, b) in enumerate(combinations(range(n), 2)):
            votes[:, a] += wins[:, i]
            votes[:, b] += 1 - wins[:, i]
            least[:, a] = np.minimum(least[:, a], wins[:, i])
            least[:, b] = np.minimum(least[:, b], 1 - wins[:, i])
        first = votes.argmax(axis=1)
        return first, least[np.arange(len(x)), first]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        first, sure = self._votes(self.top, len(self.families), x)
        langs, scores = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(first == i)
            if len(rows):
                best, least = self._votes(self.within[f], len(self.members[f]), x[rows])
                langs[rows] = np.array(self.members[f], object)[best]
                scores[rows] = sure[rows] * least
        return langs.tolist(), scores


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Hierarchy | None:
    """Fit on ``per_lang`` rows at most of each language among those with ``train``; None without any.

    Rows are drawn by a hash of their id and text, so rows without an id are told apart, and repeated rows count once.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, F.col(text_col).cast("string")).alias("h"))
    known = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row per language
    if not known:
        return None
    share = F.coalesce(*[F.when(F.col("l") == r.l, F.lit(1.5 * per_lang / max(r.n, 1))) for r in known])
    chosen = rows.filter((F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)) & F.col("t").rlike(r"\p{L}"))
    counts = chosen.mapInArrow(_sampled, "l string, bins binary, counts binary, h long").groupBy("l", "h").agg(F.first("bins").alias("bins"), F.first("counts").alias("counts"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h"))  # of about 1.5 times as many rows as stay
    sample = counts.withColumn("_n", first).filter(F.col("_n") <= per_lang).orderBy("l", "h").select("l", "bins", "counts").toArrow()
    if not sample.num_rows:
        return None
    bins, counts = sample.column("bins").to_pylist(), sample.column("counts").to_pylist()
    return Hierarchy(Rows([(np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32)) for b, c in zip(bins, counts)]), sample.column("l").to_pylist())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bins, counts, h) of (language, whole text, h): the bins that are not empty."""
    for batch in batches:
        bins, counts = [], []
        for text in batch.column(1):
            one = counted(text.as_py())
            some = np.flatnonzero(one)
            bins.append(some.astype(np.uint16).tobytes())
            counts.append(one[some].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(bins, pa.binary()), pa.array(counts, pa.binary()), batch.column(2)], ["l", "bins", "counts", "h"])


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    return _identified(docs, model, id_col, text_col, ())


def keep_identified(docs: DataFrame, model: Hierarchy | None, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that are ``und`` or score below ``least``."""
    found = _identified(docs, model, id_col, text_col, tuple(docs.columns)).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*(F.col(f"_h{i}").alias(c) for i, c in enumerate(docs.columns)))


def _identified(docs: DataFrame, model: Hierarchy | None, id_col: str, text_col: str, hand: tuple[str, ...]) -> DataFrame:
    """With the columns of ``hand`` as _h0, _h1 ..., so that no name can clash."""
    rows = docs.select(F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), F.col(text_col).cast("string")).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"_h{i}") for i, c in enumerate(hand)))
    handed = rows.schema.fields[2:]
    sent = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(0).to_pylist()
                x = np.zeros((len(texts), FEATURES))
                for i, text in enumerate(texts):
                    if text is not None and model is not None:
                        x[i] = scaled(counted(text))
                langs, scores = model.predict(x) if model is not None else ([None] * len(texts), np.zeros(len(texts)))
                langs = ["und" if t is None or model is None else lang for t, lang in zip(texts, langs)]
                scores = np.where([lang == "und" for lang in langs], 0.0, scores)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(langs), pa.array(scores), *part.columns[2:]], ["doc_id", "lang_pred", "score", *(f.name for f in handed)])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in handed))
