import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import MIN_LANGUAGE_SCORE
from tagloom.llm.common import fold
from tagloom.llm.linear import svm
from tagloom.llm.langid import FAMILY, FEATURES, Hierarchy, Rows, counted, fit, identify, keep_identified, scaled


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold("doc_id", 5, 0)
    got = {r.doc_id: r for r in identify(docs.select("doc_id", "text"), fit(docs, ~held)).collect()}
    some = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(some) > 100
    assert sum(got[r.doc_id].lang_pred == r.lang for r in some) >= 0.98 * len(some)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_the_text_counts(docs):
    model = fit(docs, F.lit(True))
    a = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    turned = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("doc_id", F.col("doc_id") + 1000)
    b = {r.doc_id - 1000: (r.lang_pred, r.score) for r in identify(turned, model).collect()}
    assert a == b


def test_odd_rows(docs, odd, none):
    model = fit(docs, F.lit(True))
    found = identify(odd, model).collect()
    assert len(found) == 9
    und = {1, 2, 6, 7}
    for r in found:
        assert (r.lang_pred == "und") == (r.doc_id in und)
        assert r.score == 0 if r.lang_pred == "und" else 0 < r.score <= 1
    left = keep_identified(odd, model, 0.0)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "4", "5", "None"]
    assert identify(none, model).count() == 0


def test_one_language_or_none(spark, none):
    df = spark.createDataFrame([(1, "some words here", "en"), (2, "other words", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, fit(df, F.lit(True))).collect()}
    assert found == {1: ("en", 1.0), 2: ("en", 1.0), 3: ("und", 0.0)}
    assert fit(none, F.lit(True)) is None
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}


def test_training_reads_whole_texts(spark):
    """Letters only after thousands of digits: a prefix of the text would teach nothing."""
    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    made = [(i, "0123456789 " * 2000 + words[lang] * 20, lang) for i in range(0, 40, 2) for i, lang in ((i, "en"), (i + 1, "de"))]
    model = fit(spark.createDataFrame(made, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(1, words["en"]), (2, words["de"])], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(asked, model).collect()} == {1: "en", 2: "de"}


def test_clean_documents_of_many_languages_stay(spark):
    """Thirteen languages in four families, one of seven: the bar of the pipeline must not depend on their number."""
    draw = random.Random(3)
    langs = ["en", "de", "fr", "es", "it", "pt", "ro", "ca", "gl", "ru", "pl", "fi", "hu"]
    words = {lang: ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 8))) for _ in range(60)] for lang in langs}
    made = [(i, " ".join(draw.choices(words[langs[i % 13]], k=80)), langs[i % 13]) for i in range(520)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = fit(docs.filter("doc_id < 260"), F.lit(True))
    asked = docs.filter("doc_id >= 260")
    found = {r.doc_id: r.lang_pred for r in identify(asked, model).collect()}
    assert all(found[i] == lang for i, _, lang in made if i >= 260)
    assert keep_identified(asked, model, MIN_LANGUAGE_SCORE).count() == 260


def test_a_guess_among_many_languages_is_below_the_bar():
    model = Hierarchy(Rows([(np.arange(FEATURES), np.ones(FEATURES))] * 4), ["en", "de", "fr", "es"])
    model.top, model.within = model.top * 0, {f: w * 0 for f, w in model.within.items()}
    _, scores = model.predict(np.zeros((3, FEATURES)))
    assert (scores < MIN_LANGUAGE_SCORE).all()


def test_features_against_plain_counts():
    text = "Ab  c-D é"
    clean = " ".join("".join(c if not c.isascii() or c.isalpha() else " " for c in f" {text.lower()} ").split(" "))
    data, kept = clean.encode(), bytearray()
    for c in data:
        if not (c == 32 and kept and kept[-1] == 32):
            kept.append(c)
    want = np.zeros(FEATURES)
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            gram = 0
            for c in kept[i : i + n]:
                gram = (gram * 257 + c) % 2**32
            want[((gram + (n - 1) * 7919) * 2654435761 % 2**32) >> (32 - FEATURES.bit_length() + 1)] += 1
    assert counted(text).tolist() == want.tolist()
    assert np.allclose(scaled(counted(text)), np.sqrt(want) / np.linalg.norm(np.sqrt(want)))


def test_machine_against_plain_descent():
    draw = np.random.default_rng(1)
    x = np.c_[draw.normal(size=(60, 5)), np.ones(60)]
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + draw.normal(size=60) * 0.3 > 0.4, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return 0.5e-3 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(6)
    for _ in range(20_000):
        w -= 0.05 * (1e-3 * w - 2 * x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w))))
    assert loss(svm(x @ x.T, y, steps=1500) @ x) < loss(w) * 1.001 + 1e-9


def test_products_in_pieces(monkeypatch):
    from tagloom.llm import langid

    monkeypatch.setattr(langid, "SPREAD", 7)
    draw, rows = np.random.default_rng(3), []
    for _ in range(40):
        bins = np.sort(draw.choice(FEATURES, 30, replace=False))
        rows.append((bins, draw.integers(1, 9, 30)))
    x, some = Rows(rows), np.arange(1, 38)
    one = x.spread(some)
    assert np.allclose(x.products(some), one @ one.T) and np.allclose(x.combined(some, np.arange(37.0)), np.arange(37.0) @ one)


def test_prediction_against_plain_votes():
    """Family first, then language, by the sum of pairwise probabilities, each pair for itself."""
    draw = np.random.default_rng(2)
    langs = ["en", "de", "nl", "fr", "es", "ru"] * 6
    rows = Rows([(np.arange(40), draw.integers(1, 5, 40) + 20 * (np.arange(40) % 6 == i % 6)) for i in range(36)])
    model, x = Hierarchy(rows, langs), rows.spread(np.arange(36))[:, :-1]

    def winner(names, machines, one):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        wins = {p: 1 / (1 + np.exp(-4 * (one @ m[:-1] + m[-1]))) for p, m in zip(pairs, machines)}
        wins |= {(b, a): 1 - p for (a, b), p in wins.items()}
        best = max(names, key=lambda n: sum(wins[n, o] for o in names if o != n))
        return best, min([wins[best, o] for o in names if o != best], default=1.0)

    found, scores = model.predict(x)
    for one, lang, score in zip(x, found, scores):
        family, p = winner(sorted({FAMILY[a] for a in langs}), model.top, one)
        best, q = winner(sorted({a for a in langs if FAMILY[a] == family}), model.within[family], one)
        assert lang == best and abs(score - p * q) < 1e-9
    assert sum(a == b for a, b in zip(found, langs)) >= 34


def test_rows_without_ids_or_with_one_id_push_no_language_out(spark):
    """Thousands of rows of one language with no id, one id, or all alike: the others are learned all the same, within the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    german = docs.filter("lang = 'de' AND length(text) > 200").limit(60)
    text = F.when(F.col("k") % 3 < 2, F.concat("text", F.lit(" "), F.col("k").cast("string"))).otherwise(F.lit("immer wieder derselbe Text"))
    copies = german.crossJoin(spark.range(100).withColumnRenamed("id", "k"))
    many = copies.select(F.when(F.col("k") % 3 > 0, F.lit(7)).cast("long").alias("doc_id"), text.alias("text"), "lang")
    model = fit(docs.unionByName(many), F.lit(True), per_lang=50)
    assert sorted(x for m in model.members.values() for x in m) == ["de", "en", "es", "fr"]
    found = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
