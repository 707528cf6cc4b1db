import random

import numpy as np

from tagloom.llm import decontam
from tagloom.llm.decontam import MIN_MATCHES, clean, contaminated, tokens


def slow(text, items):
    """Whether a stretch of some item and diagonal makes the text contaminated, without seeds."""
    t = np.array([hash(x) for x in tokens(text)])
    for u in items:
        for diagonal in range(-len(u) + 1, len(t)):
            low, high = max(0, diagonal), min(len(t), diagonal + len(u))
            same = t[low:high] == u[low - diagonal : high - diagonal]
            if same.sum() < 4:
                continue
            ends = np.cumsum(same)
            for b in range(len(same)):
                n = ends[b:] - (ends[b - 1] if b else 0)
                if ((5 * n >= 4 * np.arange(1, len(n) + 1)) & ((n >= MIN_MATCHES) | (5 * n >= 4 * len(u)))).any():
                    return True
    return False


def test_query_against_all_diagonals(spark, small, docs, rows):
    """All texts of the small table, the long ones too."""
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [np.array([hash(x) for x in tokens(r.text)]) for r in benchmark.collect()]
    got = {r.doc_id: r.contaminated for r in contaminated(docs, benchmark).collect()}
    vocabulary = {w for u in items for w in u.tolist()}
    asked = [r for r in rows if sum(hash(w) in vocabulary for w in tokens(r.text)) >= 4]
    assert all(not got[r.doc_id] for r in rows if r not in asked)
    for r in sorted(asked, key=lambda r: len(r.text or ""))[:120] + [r for r in asked if got[r.doc_id]]:
        assert got[r.doc_id] == slow(r.text, items)
    assert any(got.values())


def planted(spark):
    draw = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randint(15, 60))) for i in range(30)]
    made, truth = [], {}
    for d in range(240):
        kind, (_, item) = d % 4, items[d % 30]
        body = text(120).split()
        words = item.upper().split() if d % 3 else [w + "," for w in item.split()]
        if kind == 1:  # every sixth word replaced
            words = [w if n % 6 != 5 else draw.choice(vocabulary) for n, w in enumerate(words)]
        if kind == 2:
            words = words[:14]
        if kind < 3:
            body[60:60] = words
        truth[d] = kind < 3
        made.append((d, " ".join(body)))
    return spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_passages_with_substitutions(spark):
    docs, benchmark, truth = planted(spark)
    found = {r.doc_id: r for r in contaminated(docs, benchmark).collect()}
    assert {d: r.contaminated for d, r in found.items()} == truth
    assert all(found[d].item_id == d % 30 for d, bad in truth.items() if bad)


def test_joins_by_shuffle_and_a_crowded_filter(spark, monkeypatch):
    docs, benchmark, truth = planted(spark)
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontam, "FILTER_BITS", 16)
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 1)
    docs = docs.unionByName(docs.limit(10))
    found = contaminated(docs, benchmark).collect()
    assert len(found) == 250 and all(r.contaminated == truth[r.doc_id] for r in found)
    assert clean(docs, benchmark).count() == sum(not r.contaminated for r in found)


def test_one_word_over_and_over(spark):
    """A long text of one word against an item of that word, and a text and an item of period two that are alike in part."""
    made = [(1, "same " * 20_000), (2, "a b " * 10_000), (3, "b " * 150 + "c " * 150), (4, "same " * 9), (5, "same x y " * 3000)]
    items = [(1, "same " * 200), (2, "a c " * 100)]
    found = {r.doc_id: (r.contaminated, r.item_id, r.equal_tokens) for r in contaminated(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {1: (True, 1, 200), 2: (False, None, 0), 3: (False, None, 0), 4: (False, None, 0), 5: (False, None, 0)}


def test_best_overlap_in_pieces(monkeypatch):
    draw = random.Random(11)
    monkeypatch.setattr(decontam, "PAIRS_AT_ONCE", 40)
    for _ in range(300):
        t, u = ([draw.randrange(4) for _ in range(draw.randint(1, n))] for n in (90, 14))
        if len(u) >= 5:
            most = 0
            for d in range(-len(u) + 1, len(t)):
                same = [t[d + k] == u[k] for k in range(len(u)) if 0 <= d + k < len(t)]
                most = max([most, *(sum(same[b:e]) for b in range(len(same)) for e in range(b + 1, len(same) + 1) if 5 * sum(same[b:e]) >= 4 * (e - b))])
            want = most if most >= MIN_MATCHES or 5 * most >= 4 * len(u) else 0
            assert decontam.best_overlap(np.array(t, np.uint64), np.array(u, np.uint64)) == want


def test_odd_rows(odd, none, spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "a b c d e f"), (4, "word " * 12)], "item_id long, text string")
    found = contaminated(odd, benchmark).collect()
    assert len(found) == 9 and [r.doc_id for r in found if r.contaminated] == [3]
    left = clean(odd, benchmark)
    assert left.columns == odd.columns and left.count() == 8
    assert contaminated(none, benchmark).count() == 0
    assert not any(r.contaminated for r in contaminated(odd, benchmark.filter("false")).collect())


def plain(t, u):
    """Whether some diagonal has a stretch with four of five tokens equal that makes up ten tokens or 0.8 of the item."""
    for diagonal in range(-len(u) + 1, len(t)):
        same = [t[diagonal + k] == u[k] for k in range(len(u)) if 0 <= diagonal + k < len(t)]
        for b in range(len(same)):
            for e in range(b + 1, len(same) + 1):
                n = sum(same[b:e])
                if 5 * n >= 4 * (e - b) and (n >= MIN_MATCHES or 5 * n >= 4 * len(u)):
                    return True
    return False


def test_substituted_passages_against_plain_equality(spark):
    """Items of 5 to 25 tokens with up to a third of their places changed, and every fifth token changed."""
    draw = random.Random(4)
    items, made, truth = [], [], {}
    sized = [(15, (4, 9)), (12, (4,)), (6, (1,)), (6, (4,)), (5, (2,)), (10, (2, 5)), (20, (4, 9, 14, 19)), (15, (1, 5, 8, 12))]
    sized += [(n, tuple(draw.sample(range(n), draw.randint(1, n // 3)))) for n in (draw.randint(5, 25) for _ in range(150))]
    for i, (n, changed) in enumerate(sized):
        item = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(item)))
        text = [f"f{draw.randrange(500)}" for _ in range(12)]
        text[6:6] = ["other" if k in changed else w for k, w in enumerate(item)]
        made.append((i, " ".join(text)))
        truth[i] = plain(text, item)
    assert all(truth[i] for i in range(7)) and not truth[7] and 20 < sum(truth.values()) < 150
    docs, benchmark = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in contaminated(docs, benchmark).collect()} == truth


def test_texts_of_one_id_are_told_apart(spark):
    docs, benchmark, truth = planted(spark)
    found = contaminated(docs.selectExpr("7L AS doc_id", "text"), benchmark).collect()
    assert sum(r.contaminated for r in found) == sum(truth.values()) and len(found) == 240


def test_long_repetitive_texts_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert decontam.best_overlap(np.full(20_000, 7, np.uint64), np.full(20_000, 7, np.uint64)) == 20_000
    assert decontam.best_overlap(np.full(20_000, 7, np.uint64), np.r_[np.full(5_000, 7, np.uint64), np.full(15_000, 9, np.uint64)]) >= 5_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
