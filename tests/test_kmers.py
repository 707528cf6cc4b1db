import random

import pytest

from tagloom.operators import qc


def by_hand(seqs, k):
    found = {}
    for n, s in enumerate(seqs):
        for i in range(len(s or "") - k + 1):
            if set(m := s[i : i + k]) <= set("ACGT"):
                found.setdefault(m, []).append((n, i))
    return {m: (len(x), sum(i for _, i in x) / len(x), len({n for n, _ in x}) / len(seqs)) for m, x in found.items()}


@pytest.mark.parametrize("k", [1, 4, 12, 33])  # few k-mers, many, and too long for a number
def test_kmers_are_counted_in_one_pass_without_a_row_each(spark, monkeypatch, k):
    draw, plans = random.Random(k), []
    seqs = ["".join(draw.choices("ACGTN", [9, 9, 2, 2, 1], k=draw.randint(0, 50))) for _ in range(60)] * 25 + ["A" * 60] * 30
    seqs += [None, "", "acgtacgt" * 6, "ACGTé" + "ACGT" * 10, "A"] * 25
    monkeypatch.setattr(qc, "AT_ONCE", 3000)
    monkeypatch.setattr(qc, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.cache())
    got = {r.kmer: r for r in qc.kmer_enrichment(spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3), k, top=10**6).collect()}
    want = {m: v for m, v in by_hand(seqs, k).items() if v[0] >= 20}
    assert {m: (r["count"], round(r.mean_position, 9), round(r.read_fraction, 9)) for m, r in got.items()} == {m: (n, round(a, 9), round(f, 9)) for m, (n, a, f) in want.items()}
    text = "".join(s or "" for s in seqs)
    share, total = {b: text.count(b) / sum(text.count(c) for c in "ACGT") for b in "ACGT"}, sum(v[0] for v in by_hand(seqs, k).values())
    for m, r in got.items():
        expected = total
        for c in m:
            expected *= share[c]
        assert r.expected == pytest.approx(expected) and r.ratio == pytest.approx(r["count"] / expected)
    assert len(plans) == 1 and "Generate" not in plans[0] and plans[0].count("MapInArrow") == 1


def test_no_kmers(spark):
    assert qc.kmer_enrichment(spark.createDataFrame([("ACG",), (None,)], "seq string")).count() == 0
    assert qc.kmer_enrichment(spark.createDataFrame([], "seq string")).count() == 0
