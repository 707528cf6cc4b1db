import random
from collections import Counter

import numpy as np
import xxhash

from tagloom.llm.queries import op6_simhash
from tagloom.llm.simhash import LINK_BITS, fingerprint, golay_indices, golay_keys, group_links, near_duplicates, one_of_each


def slow_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(ids_fps):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, (i, f) in enumerate(ids_fps):
        root(i)
        for j, g in ids_fps[:n]:
            if (f ^ g).bit_count() <= LINK_BITS:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in ids_fps}


def test_fingerprints(rows):
    for r in rows:
        assert fingerprint((r.text or "").encode(), 4, 2)[0] == fingerprint((r.text or "").encode(), 4)[0] == slow_fingerprint(r.text, 4)


def test_query_against_all_pairs(spark, small, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, small).collect()}
    fps = [(r.doc_id, slow_fingerprint(r.text, 4)) for r in rows]
    want = slow_components(fps)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps}


def test_all_pairs_within_four_bits_share_a_key():
    draw = random.Random(5)
    patterns, n = golay_indices()
    assert set(n.tolist()) <= {1, 6}
    a = [draw.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum(1 << p for p in draw.sample(range(64), draw.randint(0, 4))) for x in a]
    keys = []
    for fps in (a, b):
        rows, found = golay_keys(np.array(fps, np.uint64).view(np.int64), patterns)
        sets = [set() for _ in fps]
        for r, k in zip(rows.tolist(), found.tolist()):
            sets[r].add(k)
        keys.append(sets)
    assert all(x & y for x, y in zip(*keys))


def test_large_groups_keep_their_links():
    draw = random.Random(6)
    center = draw.getrandbits(64)
    fps = list({center ^ sum(1 << p for p in draw.sample(range(64), draw.randint(0, 5))) for _ in range(400)})
    ids = np.arange(len(fps))
    found = group_links(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), ids)
    assert len(found) < len(fps)
    want = slow_components(list(zip(ids.tolist(), fps)))
    have = slow_components([])
    parent = {int(i): int(i) for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found.tolist():
        assert (fps[a] ^ fps[b]).bit_count() <= LINK_BITS
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: root(i) for i in parent} == want and have == {}


def test_copies_and_near_copies(spark):
    draw = random.Random(7)
    base = " ".join(f"w{draw.randrange(500)}" for _ in range(400))
    made = [(i, base) for i in range(300)] + [(1000 + i, base + f" tail{i}") for i in range(60)] + [(2000 + i, " ".join(f"x{draw.randrange(900)}" for _ in range(100))) for i in range(40)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 5).collect()}
    assert {found[i] for i in [*range(300), *range(1000, 1060)]} == {0}
    assert all(found[2000 + i] == 2000 + i for i in range(40))


def test_one_of_each(odd, none, spark):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 7]
    assert one_of_each(none).count() == 0
    found = near_duplicates(odd, 5).collect()
    assert len(found) == 9
    assert {r.component_id for r in found if r.doc_id in (1, 2, 6)} == {1}


def test_links_through_null_ids(spark, monkeypatch):
    """Fingerprints 0, 7 and 63, the middle one on a row without an id: it joins the others and takes their smallest id."""
    from tagloom.llm import simhash

    found = [(5, 0), (None, 7), (3, 63), (9, 1 << 40 | 0xFFF << 48)]
    marked = spark.createDataFrame(found, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: marked)
    got = {r.fp: r.component_id for r in near_duplicates(marked).collect()}
    assert got == {0: 3, 7: 3, 63: 3, found[3][1]: 9}


def test_texts_that_share_an_id_are_told_apart(spark):
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(60)) for _ in range(3)]
    made = [(1, texts[0], "a"), (1, texts[1], "a"), (2, texts[0], "b"), (1, texts[0], "c"), (None, texts[1], "d"), (None, texts[2], "e")]
    kept = one_of_each(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), texts.index(r.text)) for r in kept) == [("1", 0), ("1", 1), ("None", 2)]


def test_hot_fingerprints_are_dealt_to_many_tasks(spark, monkeypatch):
    from tagloom.llm import simhash

    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    draw = random.Random(9)
    made = [(i, "one text that many share") for i in range(95)] + [(200 + i, " ".join(f"w{draw.randrange(900)}" for _ in range(60))) for i in range(5)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert found == {i: 0 for i in range(95)} | {200 + i: 200 + i for i in range(5)}


def jaccard(a, b):
    x, y = ({" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies_by_similarity(spark):
    """Pairs at similarities around 0.8, 0.85, 0.9 and 0.95, texts of 60 to 1,500 words with words replaced: what is found, and nothing below 0.8."""
    draw = random.Random(10)
    made, pairs = [], []
    for i in range(600):
        n, wanted = draw.choice((60, 150, 400, 1500)), (0.8, 0.85, 0.9, 0.95, 0.6)[i % 5]
        one = [f"w{draw.randrange(5000)}" for _ in range(n)]
        other = list(one)
        for at in draw.sample(range(n), round((n - 4) * (0.97 - wanted) / (5 * (1.03 + wanted)))):
            other[at] = f"x{draw.randrange(5000)}"
        pairs.append((jaccard(" ".join(one), " ".join(other)), 2 * i, 2 * i + 1))
        made += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(a in kept for _, a, _ in pairs)
    assert all(b in kept for j, _, b in pairs if j < 0.8)
    for low, high, least in ((0.8, 0.86, 0.85), (0.86, 0.92, 0.95), (0.92, 1.01, 0.98)):
        some = [b not in kept for j, _, b in pairs if low <= j < high]
        assert len(some) > 60 and sum(some) >= least * len(some), (low, sum(some), len(some))


def test_copies_of_one_text_that_are_less_like_each_other(spark):
    """A hundred texts at 0.86 to 0.9 from one base, and at about 0.77 from each other: the base joins them all."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(5000)}" for _ in range(400)]
    made = [(500, " ".join(base))]
    for i in range(100):
        other = list(base)
        for at in draw.sample(range(400), 5):
            other[at] = f"x{draw.randrange(5000)}"
        made.append((i, " ".join(other)))
    assert sum(jaccard(made[i][1], made[i + 1][1]) < 0.8 for i in range(1, 100)) > 50
    assert all(jaccard(made[0][1], t) >= 0.8 for _, t in made)
    kept = {r.doc_id for r in one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert len(kept) <= 5


def test_every_link_is_found(spark, monkeypatch):
    """Pairs from 0.8 on whose fingerprints are far apart, also within a hundred texts that all look alike: no link is lost, and nothing below 0.8 goes."""
    draw = random.Random(14)
    made, pairs = [], []
    shared = [f"s{draw.randrange(5000)}" for _ in range(200)]
    for i in range(300):
        one = (list(shared) if i % 3 == 0 else []) + [f"w{draw.randrange(5000)}" for _ in range(70)]
        other = list(one)
        for at in draw.sample(range(len(one)), max(1, round(len(one) * 0.022))):
            other[at] = f"x{draw.randrange(5000)}"
        pairs.append((jaccard(" ".join(one), " ".join(other)), 2 * i, 2 * i + 1))
        made += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    assert sum(0.8 <= j < 0.83 for j, _, _ in pairs) > 20
    for far in (15, 0):
        monkeypatch.setattr("tagloom.llm.simhash.NEAR_BITS", far)
        kept = {r.doc_id for r in one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()}
        assert kept == {a for _, a, _ in pairs} | {b for j, _, b in pairs if j < 0.8}


def test_only_the_verdict_stays_on_disk(spark, docs):
    from pathlib import Path

    from tagloom.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    one = one_of_each(docs)
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert left == {"judged"} and 0 < one.count() < docs.count()


def test_texts_of_near_copies_go_to_python_in_batches_of_few_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tagloom import storage
    from tagloom.llm import simhash

    def sizes(batches):
        for batch in batches:
            yield type(batch).from_pydict({"mb": [batch.nbytes / 2**20]})

    before = spark.conf.get(storage.BATCH, None)
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    with storage.narrow(spark):
        assert max(r.mb for r in long.mapInArrow(sizes, "mb double").collect()) <= 6
    assert spark.conf.get(storage.BATCH, None) == before
    asked, kept = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, *a, **b: asked.append(df.sparkSession.conf.get(storage.BATCH)) or kept(df, *a, **b))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
    assert asked and set(asked) == {str(storage.BATCH_BYTES)} and spark.conf.get(storage.BATCH, None) == before
