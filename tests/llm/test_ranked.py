import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm import ranked
from tagloom.llm.oracles import oracle_sql
from tagloom.llm.queries import op11_block_max

ITEMS = "item_id long, text string, rank string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    total, holding = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, counts, n in docs:
            m = 25 + 75 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * holding[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms(text) if t in counts)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def made(spark, seed, n=600, words=80):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ünder", "don't", "x2", "ünder"]
    text = lambda m: " ".join(draw.choice(vocabulary[: draw.randint(2, len(vocabulary))]) for _ in range(m))
    docs = [(i, text(draw.randint(0, 60))) for i in range(n)] + [(7, text(20))] * 3 + [(None, text(30))] * 2 + [(n + 5, None), (n + 6, ""), (n + 7, "?! --")] + [(n + 10 + i, "same words here w1 w2") for i in range(200)]
    docs.append((n + 9, "w3 w4 " * 20_000))
    draw.shuffle(docs)
    items = [(i, text(draw.randint(1, 12))) for i in range(25)] + [(30, "same WORDS here"), (31, "w1 w1 w1 w2"), (32, "nowhere"), (33, None), (34, ""), (30, "same WORDS here"), (31, "w5"), (None, "w6 w7")]
    return docs, items


def test_against_every_document(spark, monkeypatch):
    docs, items = made(spark, 5)
    want = by_hand(docs, items)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    assert result(ranked.ranked(*frames)) == want
    monkeypatch.setattr(ranked, "BLOCK", 7)
    monkeypatch.setattr(ranked, "SORTED", 3)
    monkeypatch.setattr(ranked, "QUERY_BYTES", 300)  # several blocks of queries
    assert result(ranked.ranked(frames[0].repartition(5), frames[1])) == want
    assert result(ranked.ranked(*frames, k=1)) == by_hand(docs, items, 1)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """Where terms stand together, most blocks' bounds are below the floor."""
    docs = [(i, f"common t{i // 64} t{i // 64} u{i % 7}") for i in range(6400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "common t50 u3", "x")], ITEMS)
    queries = ranked.Queries(items.collect())
    index = ranked._index(df, queries, "doc_id", "text")
    totals = index.agg(F.sum("documents"), F.sum("terms")).first()
    queries.weigh(totals[0], {r[0]: r[1] for r in index.select(F.explode(F.arrays_zip("words", "held")).alias("t")).groupBy("t.words").agg(F.sum("t.held")).collect()})
    blocks = ranked._weighted(index, *totals).collect()
    bounds = [queries.bounds(__import__("numpy").array(b.words), b.maxima, __import__("numpy").zeros(3, int))[0] for b in blocks]
    tenth = by_hand(docs, [(1, "common t50 u3")])[-1][-1]
    assert len(blocks) == 100 and sum(b >= tenth for b in bounds) <= 2
    assert result(ranked.ranked(df, items)) == by_hand(docs, [(1, "common t50 u3")])


def test_query_against_sql(spark, small, duck):
    got = op11_block_max(spark, small)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == sorted(duck.execute(oracle_sql()["op11_block_max"]).fetchall())


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "same text", "x"), (2, "word", "x")], ITEMS)
    want = by_hand([(r.doc_id, r.text) for r in odd.collect()], [(1, "same text"), (2, "word")])
    assert result(ranked.ranked(odd, items)) == want
    assert result(ranked.ranked(none, items)) == [] == result(ranked.ranked(odd, items.limit(0)))
    assert ranked.ranked(none, items).columns == ["item_id", "rank", "doc_id", "score"]
