import random
from itertools import combinations

import numpy as np
import pytest

from tagloom.llm import jaccard
from tagloom.llm.oracles import oracle_sql
from tagloom.llm.queries import op13_jaccard_join


def shingled(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def by_hand(docs):
    sets = [shingled(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed, n=350):
    """Groups of near copies about the bar, a passage that many share, small sets, chains, and copies."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda m: [draw.choice(vocabulary) for _ in range(m)]
    passage, docs = text(50), []
    bases = [text(draw.choice((12, 25, 60, 150))) for _ in range(12)]
    for _ in range(n):
        kind = draw.random()
        if kind < 0.6:
            words = list(draw.choice(bases))
            for _ in range(draw.choice((0, 1, 1, 2, 3, 4))):
                at = draw.randrange(len(words))
                words[at : at + draw.choice((0, 1, 2))] = text(draw.choice((0, 1)))
        elif kind < 0.8:
            words = text(draw.randint(5, 60)) + passage + text(draw.randint(0, 20))
        else:
            words = draw.choices(["a", "b", "C"], k=draw.randint(0, 12))
        docs.append((len(docs), " ".join(words)))
    chain = text(60)
    for i in range(30):  # each links with the next, the ends do not
        docs.append((1000 + i, " ".join(chain[i : i + 45])))
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, "only null ids"), (None, "only null ids"), (2000, None), (2001, ""), (2002, " \t\n "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "w1 w2 w3 " * 5000), (2007, "w1 w2 w3 " * 4000)]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, component_id string")
    assert result(jaccard.jaccard_components(df.repartition(5))) == by_hand(docs)


def test_no_link_is_lost_without_the_first_comparisons(spark, monkeypatch):
    """The filtered pairs alone find every link between components, in a bad order of shingles too, and in small pieces."""
    docs = corpus(9, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BUCKETS", 64)
    real, calls = jaccard._linked, []

    def second_only(pairs, *rest):
        calls.append(1)
        return real(pairs, *rest) if len(calls) > 1 else real(pairs, *rest).limit(0)

    monkeypatch.setattr(jaccard, "_linked", second_only)
    assert result(jaccard.jaccard_components(df)) == by_hand(docs)


def test_prefix_lengths_lose_no_pair():
    for n in range(1, 400):
        for m in range(n, 400):
            o = jaccard.least_overlap(n, m)
            assert 100 * o >= 90 * (n + m - o) and 100 * (o - 1) < 90 * (n + m - o + 1)
            if o <= n:
                assert jaccard.index_length(n) > n - o and jaccard.prefix_length(m) > m - o


def test_pairs_of_a_shared_passage_are_filtered():
    draw = np.random.default_rng(4)
    passage = draw.integers(0, 2**63, 50, np.uint64)
    sets = [np.r_[draw.integers(0, 2**63, 250, np.uint64), passage] for _ in range(300)]
    rows = [(bytes([i // 256, i % 256]), 300, True, bytes([i // 256, i % 256]), jaccard.parities(s)) for i, s in enumerate(sets)]
    assert jaccard.class_pairs(rows) == []
    near = (b"x", 301, True, b"x", jaccard.parities(np.r_[sets[0], np.uint64(5)]))
    assert jaccard.class_pairs([*rows, near]) == [(rows[0][0], b"x")] == jaccard.class_pairs([*rows, near], 1)
    assert jaccard.class_pairs([*rows, (*near[:3], rows[0][3], near[4])]) == []


def test_bitmaps_never_show_more_than_differs():
    draw = np.random.default_rng(6)
    for n in (1, 20, 300, 4000) * 20:
        one = draw.integers(0, 2**63, n, np.uint64)
        other = np.unique(np.r_[one[draw.random(n) < 0.8], draw.integers(0, 2**63, n // 5, np.uint64)])
        assert np.bitwise_count((jaccard.parities(one) ^ jaccard.parities(other)).view(np.uint64)).sum() <= len(np.setxor1d(one, other))


def test_query_against_sql(spark, small, duck):
    got = op13_jaccard_join(spark, small)
    want = duck.execute(oracle_sql()["op13_jaccard_join"])
    assert [d[0] for d in want.description] == got.columns
    assert result(got) == sorted(want.fetchall(), key=repr)


def test_odd_rows_and_empty_tables(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(jaccard.jaccard_components(odd)) == by_hand(docs)
    got = jaccard.jaccard_components(none)
    assert result(got) == [] and got.columns == ["doc_id", "n_shingles", "component_id"]


def test_levels_go_out_compressed(spark):
    """Few shingles take little of the driver's memory, however many buckets there are."""
    from tagloom.llm import jaccard

    docs = spark.createDataFrame([("one two three four",)] * 5 + [("five six seven",)], "text string")
    sent = jaccard._shingle_levels(docs, 3)
    level = jaccard._unpacked(sent)
    assert sum(map(len, sent.value.values())) < jaccard.BUCKETS // 100
    assert len(level) == jaccard.BUCKETS and sorted(level[level > 0].tolist()) == [1, 3, 3]
    sent.destroy()


def test_a_tally_holds_no_count_for_each_bucket(monkeypatch):
    """A task's memory goes by what it counts; however often it hands on, the sums are those of all."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(4)
    parts = [draw.integers(0, 1 << 63, n, np.uint64) for n in (300, 0, 5, 900)] + [np.full(40, 17, np.uint64), np.array([jaccard.BUCKETS - 1], np.uint64)]
    want = np.bincount((np.concatenate(parts) % np.uint64(jaccard.BUCKETS)).astype(np.int64), minlength=jaccard.BUCKETS)
    tracemalloc.start()
    batches = list(jaccard._tallied(iter(parts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * jaccard.BUCKETS  # a count of 32 bits for each takes twice that
    monkeypatch.setattr(jaccard, "HELD", 70)
    many = list(jaccard._tallied(iter(parts)))
    assert len(batches) == 1 and len(many) > 10 and list(jaccard._tallied(iter([]))) == []
    size = jaccard.BUCKETS // jaccard.SLICES
    for found in (batches, many):
        got = np.zeros(jaccard.BUCKETS, np.int64)
        for i, part in ((i, p) for b in found for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            got[i * size : (i + 1) * size] += np.frombuffer(pa.decompress(part, 4 * size, codec="zstd"), np.uint32)
        assert (got == want).all()
