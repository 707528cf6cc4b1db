import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import hpylm
from tagloom.llm.common import fold


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def test_counts_and_base_are_exact_and_the_model_beats_it(docs, rows):
    got = {r.doc_id: r for r in hpylm.score(docs, ~fold("doc_id", 7, 2)).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not held[r.doc_id] for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for r in rows:
        w, g = tokens(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert g.score < 0
    some = [g for d, g in got.items() if held[d]]
    assert sum(g.score for g in some) > sum(g.base_score for g in some)


def test_probabilities_sum_to_one(spark):
    """After each word, the probabilities of all words, of the end and of an unheard word; scores of texts give them one by one."""
    words = [f"w{i}x" for i in range(6)]
    train = [(i, " ".join(words[(i * j) % 6] for j in range(1 + i % 7))) for i in range(60)]
    asked = ["", *words, "unheard", *(f"{a} {b}" for a in [*words, "unheard"] for b in [*words, "unheard"])]
    df = spark.createDataFrame(train + [(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(df, F.col("doc_id") < 1000).collect()}
    p = {t: 10 ** got[1000 + i] for i, t in enumerate(asked)}
    # With e(x) = p(end | x), one text of x has p(x | start) e(x), and x y has p(x | start) p(y | x) e(y).
    # That all follows of x add up to one gives e; those of the start must then add up to one as well.
    heard, e = [*words, "unheard"], dict.fromkeys([*words, "unheard"], 0.3)
    for _ in range(2000):
        e = {x: 1 / (1 + sum(p[f"{x} {y}"] / (p[x] * e[y]) for y in heard)) for x in heard}
    assert p[""] + sum(p[x] / e[x] for x in heard) == pytest.approx(1, abs=1e-4)


def plain_model(train, sweeps, kept, seed):
    """log10 p(text) of a two-level Pitman-Yor model, seated customer by customer: take one out, seat it anew."""
    draw = random.Random(seed)
    flat = [(a, b) for t in train for a, b in zip([None, *tokens(t)], tokens(t))]
    pairs = Counter(flat)
    spread = Counter(pairs.values()), Counter(Counter(b for _, b in pairs).values())
    d = tuple(min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5 for n in spread)
    theta, vocabulary = hpylm.STRENGTH, len({b for _, b in flat}) + 1
    low, high = defaultdict(lambda: defaultdict(list)), defaultdict(list)  # restaurant -> dish -> table sizes

    def p_high(w):
        n, t = sum(map(sum, high.values())), sum(map(len, high.values()))
        return (sum(high[w]) - d[1] * len(high[w]) + (theta[1] + d[1] * t) / vocabulary) / (theta[1] + n)

    def p_low(u, w):
        r = low[u]
        n, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        return (sum(r[w]) - d[0] * len(r[w]) + (theta[0] + d[0] * t) * p_high(w)) / (theta[0] + n)

    def sit(tables, discount, new):
        at = draw.random() * (sum(tables) - discount * len(tables) + new)
        for i, n in enumerate(tables):
            at -= n - discount
            if at < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        at = draw.randrange(sum(tables))
        for i, n in enumerate(tables):
            at -= n
            if at < 0:
                tables[i] -= 1
                if not tables[i]:
                    del tables[i]
                    return True
                return False

    def seat_high(w):
        sit(high[w], d[1], (theta[1] + d[1] * sum(map(len, high.values()))) / vocabulary)

    def seat(u, w):
        if sit(low[u][w], d[0], (theta[0] + d[0] * sum(map(len, low[u].values()))) * p_high(w)):
            seat_high(w)

    for u, w in flat:
        seat(u, w)
    out = []
    for sweep in range(sweeps):
        for u, w in flat:
            if leave(low[u][w]):
                leave(high[w])
            seat(u, w)
        if sweep >= sweeps - kept:
            out.append({u: {w: p_low(u, w) for w in {b for _, b in flat}} for u in {a for a, _ in flat}})
    return lambda u, w: sum(o[u][w] for o in out) / kept


def test_against_a_plain_sampler(spark):
    draw = random.Random(3)
    train = [" ".join(draw.choices("abcdefgh", [40, 20, 10, 8, 5, 3, 2, 1], k=draw.randint(1, 12))) for _ in range(50)]
    asked = [" ".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(train + asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(df, F.col("doc_id") < 50, sweeps=40, kept=30).collect()}
    p = plain_model(train, 60, 50, 1)
    seen = {a for t in train for a in [None, *tokens(t)[:-1]]}
    off = []
    for i, t in enumerate(train + asked):
        w = tokens(t)
        if all(x in seen for x in w[:-1]):
            off.append((got[i] - sum(math.log10(p(u, x)) for u, x in zip([None, *w], w))) / len(w))
    assert len(off) > 80 and max(map(abs, off)) < 0.04 and sum(map(abs, off)) < 0.01 * len(off)


def test_scores_do_not_depend_on_partitions(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.doc_id: r.score for r in hpylm.score(docs.repartition(n), ~fold("doc_id", 7, 2)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_held_out_likelihood(spark):
    """Whole previous words tell more than their endings: log10 per token, and rows of training are remembered."""
    held = fold("doc_id", 7, 2)
    found = hpylm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), ~held)
    a = {r.held: r.a for r in found.groupBy(held.alias("held")).agg((F.sum("score") / F.sum("n_tokens")).alias("a")).collect()}
    assert a[True] > -3.49 and a[False] > -1.8


def test_seating_follows_the_restaurant():
    n = 4000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tables, _ = hpylm.seat(np.full(n, 5), np.full(n, 0.4), np.full(n, 0.3), 0.5, keys, 1)

    def exact(n=5, base=0.4, slope=0.3, d=0.5):
        p = {1: 1.0}
        for seated in range(1, n):
            q = Counter()
            for t, x in p.items():
                opens, joins = base + slope * t, seated - d * t
                q[t + 1] += x * opens / (opens + joins)
                q[t] += x * joins / (opens + joins)
            p = q
        return sum(t * x for t, x in p.items())

    assert tables.min() >= 1 and tables.max() <= 5
    assert tables.mean() == pytest.approx(exact(), abs=0.06)


def test_large_dishes_are_seated_in_batches(monkeypatch):
    keys = np.arange(300, dtype=np.uint64)
    args = np.full(300, 5000), np.full(300, 2.0), np.full(300, 0.5), 0.5, keys, 3
    tables, weight = hpylm.seat(*args)
    assert hpylm.seat(np.array([10_000_000, 1]), np.full(2, 2.0), np.full(2, 0.5), 0.5, keys[:2], 0)[0][1] == 1
    monkeypatch.setattr(hpylm, "SINGLE", 10**9)
    one_by_one, _ = hpylm.seat(*args)
    assert np.isfinite(weight).all() and tables.mean() == pytest.approx(one_by_one.mean(), rel=0.03)
    assert tables.std() == pytest.approx(one_by_one.std(), rel=0.25)


def test_odd_rows(odd, none):
    found = hpylm.score(odd.select("doc_id", "text", "score"), F.col("doc_id") != 2).collect()
    assert len(found) == 9
    assert {r.n_tokens for r in found if r.doc_id in (1, 2, 6)} == {1}
    assert hpylm.score(none, F.lit(True)).count() == 0


def test_nothing_to_learn_from(docs):
    found = hpylm.score(docs.limit(5), F.lit(False)).collect()
    assert len(found) == 5 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in found)
