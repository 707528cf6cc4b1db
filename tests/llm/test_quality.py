import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa  # noqa: F401
import xxhash

from tagloom.llm.quality import BINS, BITS, importance, kth_largest, largest, ngram_bins, WordHashes


def slow_bins(text):
    h = [xxhash.xxh32_intdigest(w) for w in (text or "").encode().lower().split()]
    pairs = [(a * 0x85EBCA6B + b * 0xC2B2AE35) % 2**32 for a, b in zip(h, h[1:])]
    return [(x * 0x9E3779B1 % 2**32) >> (32 - BITS) for x in h + pairs]


def test_bins(rows):
    bins, sizes = ngram_bins([(r.text or "").encode() for r in rows[:20]], WordHashes())
    assert bins.tolist() == [b for r in rows[:20] for b in slow_bins(r.text)]
    assert sizes.tolist() == [len(slow_bins(r.text)) for r in rows[:20]]


def test_weights_against_plain_counts(spark, docs, rows):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(slow_bins(r.text))
        if r.doc_id in good:
            target.update(slow_bins(r.text))
    n, m = sum(raw.values()) + BINS, sum(target.values()) + BINS
    got = {r.doc_id: r for r in importance(docs, labels).collect()}
    for r in rows:
        want = sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in slow_bins(r.text))
        assert math.isclose(got[r.doc_id].log_weight, want, abs_tol=1e-6)
    share = len(good) / labels.count()
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    least = keys[math.ceil(share * len(rows)) - 1]
    assert all(r.selected == (r.gumbel_key >= least) for r in got.values())
    again = {r.doc_id: r.log_weight for r in importance(docs.repartition(7), labels).collect()}
    assert again == {d: r.log_weight for d, r in got.items()}


def test_kth_largest(spark):
    draw = random.Random(8)
    values = [draw.gauss(0, 100) for _ in range(3000)] + [5.0] * 500 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 1700, len(values)):
        assert kth_largest(df, "x", k) == ordered[k - 1]


def test_gumbel_noise_samples_by_weight(spark):
    """With equal weights every document has the same chance."""
    df = spark.createDataFrame([(i, "same words here") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    found = importance(df, labels, share=0.3).collect()
    assert sum(r.selected for r in found) == 600
    noise = np.array([r.gumbel_key - r.log_weight for r in found])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.1


def test_held_out_separation(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = {r.doc_id: r.selected for r in importance(docs, labels.filter("doc_id % 2 = 0"), share=0.85).collect()}
    some = [(r.quality, found[r.doc_id]) for r in labels.filter("doc_id % 2 = 1").collect()]
    assert sum(q == 1 and not s for q, s in some) <= 0.05 * sum(q == 1 for q, _ in some)
    assert sum(q == 0 and s for q, s in some) <= 0.25 * sum(q == 0 for q, _ in some)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    found = importance(odd, labels).collect()
    assert len(found) == 9
    assert all(r.n_features == 0 and r.log_weight == 0 for r in found if r.doc_id in (1, 2, 6))
    assert importance(none, labels).count() == 0
    assert all(r.selected for r in importance(odd, labels.filter("false")).collect())


def test_exactly_k_with_ties(spark):
    """Twenty rows, ten of one id and five without one: half means ten, whoever ties."""
    made = [(i, "alike words") for i in range(5)] + [(7, "alike words")] * 10 + [(None, "alike words")] * 5
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for share in (0.0, 0.05, 0.3, 0.5, 0.7, 0.95, 1.0):
        found = importance(df, labels, share=share).collect()
        assert len(found) == 20 and sum(r.selected for r in found) == math.ceil(20 * share), share
        kept = [r.gumbel_key for r in found if r.selected]
        assert not kept or min(kept) >= max([r.gumbel_key for r in found if not r.selected], default=-math.inf)


def test_largest_by_id_among_equal_keys(spark):
    df = spark.createDataFrame([(i % 4 if i % 5 else None, 1.0) for i in range(40)] + [(9, 2.0)], "doc_id long, gumbel_key double")
    want = sorted([(9, 2.0)] + [(i % 4 if i % 5 else None, 1.0) for i in range(40)], key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in (0, 1, 2, 9, 10, 33, 35, 41):
        got = sorted(((r.doc_id, r.gumbel_key) for r in largest(df, "gumbel_key", k).filter("selected").collect()), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        assert got == want[:k], k
