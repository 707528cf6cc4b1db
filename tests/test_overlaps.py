import random

import pyarrow.parquet as pq

from tagloom import catalog
from tagloom.operators.analysis import overlap_components, per_target


def slow(blocks):
    """A block opens an island if no block sorted before it in its group ends behind its start."""
    out = {}
    for g, s, e in set(blocks):
        opens = s is None or not any(h == g and t is not None and f is not None and f > s and (t < s or t == s and e is not None and f < e) for h, t, f in blocks)
        out[g] = out.get(g, 0) + opens
    return out


def found(df):
    return {r.grp: r.components for r in df.collect()}


def test_whole_table_against_a_sweep(spark):
    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()
    want, reach = {}, {}
    for g, s, e in sorted((f"chr{r['o_custkey'] % 3}", r["o_orderkey"] * 37 % 200_000, r["o_orderkey"] * 37 % 200_000 + 50 + r["o_custkey"] % 400) for r in rows):
        want[g] = want.get(g, 0) + (s >= reach.get(g, s))
        reach[g] = max(e, reach.get(g, e))
    assert found(catalog.queries()["overlap_components_whole"](spark, sf)) == want
    assert sum(want.values()) > 100


def test_islands_over_many_bins(spark):
    draw = random.Random(5)
    blocks = [("hot", s, s + draw.choice([0, 1, 3, 9, 40])) for s in (draw.randrange(-2000, 2000) for _ in range(500))]
    blocks += [("hot", 300, 1200), ("far", 5, 905), ("far", 904, 905), ("far", 905, 910), (None, 1, 2), (None, 2, 3), (None, 2, 2), (None, 2, 2)]
    blocks += [("odd", None, 9), ("odd", None, None), ("odd", 4, None), ("odd", 4, 8), ("odd", 5, 6)]
    df = spark.createDataFrame(blocks, "grp string, start long, end long")
    want = slow(blocks)
    assert want["far"] == 2 and want["hot"] > 50
    for width in (7, 50, 10_000):
        assert found(overlap_components(df, width)) == want


def test_molecules_of_targets_without_pairs(spark, monkeypatch):
    """Against all pairs, with repeated ids and empty intervals; of single intervals no pair is made."""
    from tagloom.operators import analysis

    draw = random.Random(6)

    def made(n, size):
        return [(draw.choice(["a", "b", None]), s, s + draw.choice([0, 1, 5, size]), draw.choice([i, i, i % 7])) for i, s in ((i, draw.randrange(-300, 25_000)) for i in range(n))]

    m, t = made(400, 3000), made(60, 900)
    frames = lambda m, t: (spark.createDataFrame(m, "chrom string, start long, end long, molecule long"), spark.createDataFrame(t, "chrom string, start long, end long, target long"))
    want = lambda m, t: {k: len({x[3] for x in m for y in t if y[3] == k and x[0] is not None and x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}) for k in {y[3] for y in t}}
    assert {r.target: r.molecules for r in per_target(*frames(m, t)).collect()} == want(m, t)
    m, t = ([(c, s, s + 40, i) for i, (c, s, _, _) in enumerate(rows) if c] for rows in (m, t))
    monkeypatch.setattr(analysis, "_overlaps", lambda m, t: spark.createDataFrame([], "target long, molecule long"))
    assert {r.target: r.molecules for r in per_target(*frames(m, t)).collect()} == want(m, t)
