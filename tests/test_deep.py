"""Molecules of more reads than a task should hold: all of them count."""

import random

import pytest

from tagloom.operators import consensus, studies

READS = "src_index long, key string, seq string, qual string"


def test_all_reads_of_a_deep_molecule_vote(spark):
    n = consensus.MANY
    rows = [(i, "m", "ACGT", "IIII") for i in range(n)] + [(n + i, "m", "TTTT", "IIII") for i in range(2 * n)] + [(3 * n, "m", "TTTTA", "IIIII"), (7, "n", "GG", "II")]
    df = spark.createDataFrame(rows, READS).repartition(3)
    assert {r.key: (r.seq, r.reads, r.qual) for r in consensus.records(df, ("key",)).collect()} == {"m": ("TTTT", 3 * n + 1, "IIII"), "n": ("GG", 1, "FF")}
    assert {r.key: (r.seq, r.reads, r.support) for r in consensus.fast(df, ("key",)).collect()} == {"m": ("TTTT", 3 * n + 1, 2 * n), "n": ("GG", 1, 1)}
    places = consensus.columns(df.filter("key = 'm'"), ("key",)).orderBy("position").collect()
    assert [(r.base, r.n) for r in places] == [("T", 3 * n + 1)] * 4


def test_deep_molecules_are_called_as_others(spark, monkeypatch):
    draw = random.Random(6)
    rows = []
    for i in range(1500):
        n = draw.choice((8, 9, 10))
        rows.append((i, f"m{draw.randrange(i % 40 + 1)}", "".join(draw.choices("ACGTN", (60, 5, 5, 25, 5), k=n)), "".join(draw.choices("!#5I~", k=draw.choice((n, n - 2))))))
    rows += [(2000 + i, "none", draw.choice(("", "AC", "AC", "AG", "AG")), "#I") for i in range(60)] + [(3000 + i, "null", None if i % 2 else "AC", None if i % 3 else "5I") for i in range(60)]
    df = spark.createDataFrame(rows, READS)

    def found():
        records = {r.key: (r.reads, r.seq, r.qual, r.mean_error, r.mean_quality) for r in consensus.records(df, ("key",), min_reads=2).collect()}
        places = {(r.key, r.position): (r.base, r.n, r.phred, r.p_error) for r in consensus.columns(df, ("key",)).collect()}
        return records, places, {r.key: (r.reads, r.support, r.seq, r.qual) for r in consensus.fast(df, ("key",)).collect()}

    want = found()
    monkeypatch.setattr(consensus, "MANY", 20)
    got = found()
    assert got[2] == want[2] and sum(r[0] > 20 for r in got[2].values()) > 10 and sum(r[0] <= 20 for r in got[2].values()) > 5
    for mine, theirs in zip(got[:2], want[:2]):
        assert mine.keys() == theirs.keys() and len(mine) > 20
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for k in mine for x, y in zip(mine[k], theirs[k]))


def test_templates_of_all_reads(spark):
    draw = random.Random(8)
    one, two = ("".join(draw.choices("ACGT", k=60)) for _ in range(2))
    rows = [(i, "S", "m", one, "I" * 60) for i in range(10_000)] + [(10_000 + i, "S", "m", two, "I" * 60) for i in range(5_000)] + [(20_000 + i, "S", "n", two if i else one, "I" * 60) for i in range(4)]
    df = spark.createDataFrame(rows, "src_index long, sample_id string, umi string, seq string, qual string").repartition(3)
    clusters = studies.template_clusters(df)
    assert sorted(map(tuple, clusters.collect())) == [("S", "m", 15_000, 2, one), ("S", "n", 4, 2, one)]
