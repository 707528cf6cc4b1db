import math
import random
import zlib

from pyspark.sql import functions as F

from tagloom.llm.common import fold
from tagloom.llm.toxicity import LEXICON, Finder, Lexicon, abuse, fit, score, signals_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_exactly_one_edit():
    draw, lexicon = random.Random(4), Lexicon()
    long_terms = [t for t in LEXICON if len(t) > 4]
    for _ in range(4000):
        word = list(draw.choice(long_terms))
        for _ in range(draw.choice((0, 1, 1, 2, 3))):
            at = draw.randrange(len(word))
            word[at : at + draw.choice((0, 1))] = draw.choice(([], [draw.choice("abcdeiorst")], [draw.choice("abcdeiorst")]))
            word = word or ["a"]
        word = "".join(word)
        near = min(distance(word, t) for t in long_terms)
        swapped = any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] in long_terms for i in range(len(word) - 1))
        doubled = any(word == t[: i + 1] + t[i:] for t in LEXICON if len(t) == 4 for i in range(4))
        assert lexicon.find(word) == (1 if word in LEXICON else 2 if near <= 1 or swapped or doubled else 0), word


def test_automaton_accepts_words_whose_beginning_is_near_a_stem():
    draw, stems = random.Random(5), frozenset(("depper", "widerl", "imbéc", "crétin", "estup", "arsc", "ekelh"))
    lexicon, hits = Lexicon((), stems), 0
    for _ in range(6000):
        word = list(draw.choice(sorted(stems)) + draw.choice(("", "s", "ich", "en")))
        for _ in range(draw.choice((0, 1, 1, 2, 3))):
            at = draw.randrange(len(word))
            word[at : at + draw.choice((0, 1))] = draw.choice(([], [draw.choice("abcdeiprst")], [draw.choice("abcdeiprst")]))
            word = word or ["a"]
        word = "".join(word)
        near = any(distance(word[:n], t) <= 1 for t in stems if len(t) > 4 for n in range(len(word) + 1))
        want = 3 if any(word.startswith(t) for t in stems) else 4 if near else 0
        assert lexicon.find(word) == want, word
        hits += want == 4
    assert hits > 1000


def test_short_terms_and_excluded_words():
    lexicon = Lexicon(excluded=frozenset(("trashy", "idot")))
    assert [lexicon.find(w) for w in ("fool", "foool", "folo", "sucm", "food", "pool", "scumm")] == [1, 2, 2, 2, 0, 0, 2]
    assert [lexicon.find(w) for w in ("trashy", "idot", "trashh", "idoit", "trash")] == [0, 0, 2, 2, 1]


def test_query_against_plain_scores(spark, small, docs, rows):
    """Scores of the whole query, from signals computed apart by plain edit distances."""
    from tagloom.llm.queries import op5_toxicity
    from tagloom.llm.toxicity import MARKS, SIGNALS, SIGNS

    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet"), ~fold("doc_id", 4, 2))
    lexicon, cache = model.lexicon, {}

    def kind(word):
        if word in LEXICON:
            return 1
        if any(word.startswith(t) for t in lexicon.stems):
            return 3
        if word in lexicon.excluded:
            return 0
        plain = word if word.isalpha() else word.translate(SIGNS)
        swapped = any(plain[:i] + plain[i + 1] + plain[i] + plain[i + 2 :] in LEXICON for i in range(len(plain) - 1))
        doubled = any(plain == t[: i + 1] + t[i:] for t in LEXICON if len(t) == 4 for i in range(4))
        if plain in LEXICON or swapped or doubled or any(abs(len(t) - len(plain)) < 2 and distance(plain, t) <= 1 for t in LEXICON if len(t) > 4):
            return 2
        long = [t for t in lexicon.stems if len(t) > 4]
        return 4 if any(plain.startswith(t) for t in lexicon.stems) or any(distance(plain[:n], t) <= 1 for t in long for n in (len(t) - 1, len(t), len(t) + 1)) else 0

    class Plain(dict):
        def __missing__(self, word):
            if word not in cache:
                cache[word] = kind(word.strip(MARKS))
            return cache[word]

    got = {r.doc_id: r for r in op5_toxicity(spark, small).collect()}
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:120]:
        total = sum(w * x for w, x in zip(model.weights, (*signals_of(r.text, Plain()), 1.0)))
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-total))) < 1e-9
        assert tuple(got[r.doc_id][s] for s in SIGNALS) == signals_of(r.text, Plain())


def test_the_automaton_alone_catches_misspellings(spark):
    """Toxic texts whose terms are all misspelled, without labels to learn from."""
    draw = random.Random(6)
    terms = [t for t in LEXICON if len(t) > 5]
    made = []
    for i in range(200):
        t = list(draw.choice(terms))
        at = draw.randrange(1, len(t) - 1)
        t[at : at + 1] = draw.choice(([], [t[at], t[at]], ["x"], [t[at], "q"]))
        words = draw.choices(("river", "stone", "quiet", "market", "window", "paper"), k=20)
        made.append((i, " ".join([*words[:10], "you", "".join(t), "!", *words[10:]]) if i % 2 else " ".join(words)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    model = fit(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    found = {r.doc_id: r.predicted for r in score(df, model).collect()}
    assert sum(found[i] for i in range(1, 200, 2)) == 100 and not any(found[i] for i in range(0, 200, 2))


def test_misspellings_and_signs():
    lexicon = Lexicon()
    assert [lexicon.find(w) for w in ("idiot", "idi0t", "1d10t", "idoit", "idiott", "idot", "scvm", "table")] == [1, 2, 2, 2, 2, 2, 0, 0]


def test_quotation_counts_less_than_abuse():
    finder = Finder(Lexicon())
    for worse, better in (("you are such an idiot !", 'he said the word "idiot" is an insult'),):
        at = [next(i for i, w in enumerate(t.lower().split()) if finder[w]) for t in (worse, better)]
        hits = [[finder[w] for w in t.lower().split()] for t in (worse, better)]
        assert abuse(worse.split(), at[0], hits[0]) > 0.8 > 0.2 > abuse(better.split(), at[1], hits[1])
    assert signals_of(None, finder) == signals_of("", finder) == signals_of("plain words", finder)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = fold("doc_id", 4, 2)
    model = fit(docs, labels, ~held)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    some = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hit = sum(t and p for t, p in some)
    assert hit >= 0.85 * sum(t for t, _ in some)
    assert hit >= 0.9 * sum(p for _, p in some)
    assert model.lexicon.stems


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    model = fit(odd, labels, F.lit(True))
    found = score(odd, model).collect()
    assert len(found) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    empty = {r.score for r in found if r.doc_id in (1, 2, 6)}
    assert len(empty) == 1
    assert score(none, model).count() == 0
    assert fit(odd, labels.filter("false"), F.lit(True)).lexicon.stems == frozenset()
