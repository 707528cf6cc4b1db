"""Nulls and collisions against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import correction, studies

COUNTS = "sample_id string, key string, cnt long"


def test_counts_are_permuted_exactly(spark):
    draw = random.Random(1)
    rows = [(f"S{i % 3}", f"{i:06d}".translate(str.maketrans("0123456789", "ACGTACGTAC")) + f"x{i}", draw.randint(1, 50)) for i in range(3000)] + [("one", "AAAA", 7)]
    df = spark.createDataFrame(rows, COUNTS)
    for seed in (0, 5):
        dealt = studies.counts_dealt_anew(df, seed).collect()
        assert sorted((r.sample_id, r.key) for r in dealt) == sorted(r[:2] for r in rows)
        for sample in ("S0", "S1", "S2", "one"):
            assert Counter(r.cnt for r in dealt if r.sample_id == sample) == Counter(c for s, _, c in rows if s == sample)
        before = {r[:2]: r[2] for r in rows}
        assert sum(before[r.sample_id, r.key] != r.cnt for r in dealt) > 2500
    assert "_h" not in studies.counts_dealt_anew(df, 0).columns and studies.counts_dealt_anew(df.limit(0), 0).count() == 0


def test_no_window_over_a_whole_sample(spark):
    plan = studies.counts_dealt_anew(spark.createDataFrame([("a", "ACGT", 1)], COUNTS), 0)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "_h" in line:
            assert "_r" in line.split("windowspecdefinition")[1]


def test_count_ratios_find_parents(spark):
    draw, counts = random.Random(2), {}
    for _ in range(60):
        parent = "".join(draw.choices("ACGT", k=8))
        counts[parent] = draw.randint(40, 80)
        at = draw.randrange(8)
        child = parent[:at] + draw.choice([c for c in "ACGT" if c != parent[at]]) + parent[at + 1 :]
        counts.setdefault(child, draw.randint(1, 2))
    got = {r.ratio: r for r in studies.count_ratios(spark.createDataFrame([("S", k, c) for k, c in counts.items()], COUNTS), (2, 10), shuffles=6).collect()}
    pairs = [(a, b) for a in counts for b in counts if a < b and sum(x != y for x, y in zip(a, b)) == 1]
    for ratio in (2, 10):
        assert got[ratio].pairs == len(pairs) and got[ratio].observed == sum(max(counts[a], counts[b]) >= ratio * min(counts[a], counts[b]) for a, b in pairs)
        assert got[ratio].excess == pytest.approx(got[ratio].observed - got[ratio].null_mean) and got[ratio].z > 2


def greedy(seqs, share):
    found = []
    for s in seqs:
        for c in found:
            n = min(len(c[0]), len(s))
            if sum(x != y for x, y in zip(c[0], s)) <= share * n:
                c[1] += 1
                break
        else:
            found.append([s, 1])
    return [n for _, n in found]


def test_leaders_against_plain_clustering():
    draw = random.Random(3)
    for _ in range(60):
        bases = ["".join(draw.choices("ACGTN", k=draw.choice((20, 40)))) for _ in range(3)]
        seqs = ["".join(draw.choice("ACGT") if draw.random() < 0.04 else c for c in draw.choice(bases))[: draw.randint(0, 40)] for _ in range(draw.randint(1, 40))]
        assert studies.leaders([s.encode() for s in seqs], 0.05) == greedy(seqs, 0.05)


def test_planted_collisions(spark):
    draw, rows = random.Random(4), []
    for g in range(40):
        templates = ["".join(draw.choices("ACGT", k=60)) for _ in range(2 if g % 4 == 0 else 1)]
        for i in range(2 if g == 39 else 10):
            rows.append((len(rows), "S", f"u{g}", templates[i % len(templates)], "I" * 60))
    for i in range(10):  # one odd read is no second template
        rows.append((len(rows), "S", "odd", "A" * 60 if i else "C" * 60, "I" * 60))
    clusters = studies.template_clusters(spark.createDataFrame(rows, "src_index long, sample_id string, umi string, seq string, qual string"))
    got = {r.umi: r.templates for r in clusters.collect()}
    assert got == {f"u{g}": 2 if g % 4 == 0 else 1 for g in range(39)} | {"odd": 1}
    space = spark.createDataFrame([("S", 0.5)], "sample_id string, lambda double")
    r = studies.template_collisions(clusters, space).first()
    chance = (1 - math.exp(-0.5) - 0.5 * math.exp(-0.5)) / (1 - math.exp(-0.5))
    assert (r.groups, r.split, r.trials, r.detectable) == (40, 10, 39, 1.0)
    assert r.corrected == pytest.approx(0.25) and r.expected == pytest.approx(chance) and r.ratio == pytest.approx(0.25 / chance)
    assert studies.template_collisions(clusters, space, trials=7).first().trials == 7


def test_log_factorials_of_large_counts(spark):
    import time

    numbers = [0, 1, 2, 255, 256, 257, 10_000, 10**9, 4 * 10**12]
    begin = time.perf_counter()
    got = {r.n: r.f for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", correction.log_factorial(F.col("n")).alias("f")).collect()}
    assert time.perf_counter() - begin < 20
    for n in numbers:
        assert got[n] == pytest.approx(math.lgamma(n + 1), rel=1e-14, abs=1e-14)


def test_dependent_positions_show(spark):
    draw = random.Random(6)
    free = ["".join(draw.choices("ACGT", k=6)) for _ in range(12_000)]
    tied = [k[:1] + k[0] + k[2:] if draw.random() < 0.5 else k for k in free]
    rows = [(s, k, 1) for s, keys in (("free", free), ("tied", tied)) for k in keys]
    got = {(r.sample_id, r.k): r for r in studies.independence_by_width(spark.createDataFrame(rows, COUNTS)).collect()}
    assert abs(got["free", 2].log10_excess) < 0.003 < 0.01 < got["tied", 2].log10_excess and got["tied", 3].slope > got["free", 3].slope
    assert got["free", 1].log10_excess == pytest.approx(0, abs=1e-12) and got["free", 3].windows == 4 and ("free", 4) not in got


def test_exactness_and_chain_votes(spark):
    from tagloom.operators import analysis

    called = spark.createDataFrame([("S", "ACGT"), ("S", "acgt"), ("S", "ACGA"), ("T", "AC"), (None, "AC")], "sample_id string, seq string")
    truth = spark.createDataFrame([("S", "ACGT"), ("S", "TTTT"), ("S", "TTTT"), ("U", "GG")], "sample_id string, seq string")
    got = {r.sample_id: tuple(r)[1:] for r in analysis.exactness(called, truth).collect()}
    assert got["S"] == (3, 2, pytest.approx(2 / 3), 0.5) and got["T"] == (1, 0, 0.0, 0.0) and got["U"] == (0, 0, 0.0, 0.0)
    rows = [("c", "A", "x"), ("c", "A", "y"), ("c", "A", " y"), ("c", "A", "x"), ("c", "B", "z"), ("", "A", "x"), (None, "A", "x"), ("d", "A", None), ("d", "A", " ")]
    df = spark.createDataFrame(rows, "cell string, locus string, junction string")
    assert {tuple(r) for r in analysis.modal_chains(df).collect()} == {("c", "A", "y", 2, 4), ("c", "B", "z", 1, 1)}
    assert {tuple(r) for r in analysis.modal_chains(df, 2).collect()} == {("c", "A", "y", 2, 4)}


def test_a_barcode_that_two_cells_share_votes_in_both(spark, monkeypatch):
    """Its reads make one consensus, as in the query's SQL; by cell, y would have three votes for CCC."""
    from tagloom import catalog

    rows = [("S1", c, u, s, "IIIIIIIIIIII") for c, u, s in [("x", "shared", "AAAAAAAAAGGG"), ("x", "shared", "AAAAAAAAAGGG"), ("y", "shared", "AAAAAAAAACCC"), ("y", "one", "AAAAAAAAACCC"), ("y", "two", "AAAAAAAAACCC"), ("x", "three", "AAAAAAAAAGGG"), ("x", "four", "AAAAAAAAAGGG")]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "src_index long, sample_id string, cell string, umi_true string, seq string, qual string")
    monkeypatch.setattr(catalog, "reads", lambda spark, sf_dir, index=True: df if index else df.drop("src_index"))
    assert {tuple(r) for r in catalog.modal_chains(spark, "").collect()} == {("x", "A", "GGG", 3, 3), ("y", "A", "CCC", 2, 3)}


def test_equal_reads_are_compared_once(monkeypatch):
    """As plain clustering finds them, from rows of distinct reads only."""
    draw, widest = random.Random(5), []
    kept = studies.np.arange
    monkeypatch.setattr(studies.np, "arange", lambda n, *a: widest.append(n) or kept(n, *a))
    seqs = ["".join(draw.choices("ACGT", k=30)) for _ in range(5)]
    some = [draw.choice([*seqs, seqs[0][:20], seqs[1][:-1] + "N", ""]) for _ in range(600)]
    assert studies.leaders([s.encode() for s in some], 0.05) == greedy(some, 0.05)
    assert widest == [len(set(some))]
    assert studies.leaders([b""] * 3, 0.05) == [3] and studies.leaders([], 0.05) == []


def test_clusters_are_made_once(spark, tmp_path):
    def noted(batches):
        (tmp_path / str(random.random())).touch()
        yield from batches

    clusters = spark.createDataFrame([("S", f"u{i}", 1, "ACGT" * 5) for i in range(50)], "sample_id string, umi string, templates int, first string").coalesce(1)
    r = studies.template_collisions(clusters.mapInArrow(noted, clusters.schema), spark.createDataFrame([("S", 0.5)], "sample_id string, lambda double")).first()
    assert (r.groups, r.split, r.trials, r.detectable) == (50, 0, 49, 0.0) and len(list(tmp_path.iterdir())) == 1


def test_kmers_of_a_contig_of_one_sequence_are_not_joined_again(spark, monkeypatch):
    draw, written, rows = random.Random(7), studies.written, {}
    seqs = ["".join(draw.choices("AC", k=draw.randint(2, 9))) for _ in range(8)] + [None, ""]
    contigs = [(draw.choice(["x", "y", None]), draw.choice(["a", "b", "c", "d", "e", "f", "g", None]), draw.choice(seqs)) for _ in range(25)] + [("x", f"n{i}", seqs[0]) for i in range(40)]
    molecules = [(draw.choice(["x", "y", None]), draw.choice(seqs)) for _ in range(6)]

    def seen(df, name):
        out = written(df, name)
        rows[name] = out
        return out

    monkeypatch.setattr(studies, "written", seen)
    found = studies.kmer_coverage(spark.createDataFrame(contigs, "cell string, contig string, seq string"), spark.createDataFrame(molecules, "cell string, seq string"), 4)

    def mers(s):
        return {s[i : i + 4] for i in range(len(s or "") - 3)}

    want = {}
    for cell, contig, s in contigs:
        want.setdefault((cell, contig), set()).update(mers(s))
    have = {(cell, m) for cell, s in molecules if cell for m in mers(s)}
    assert {(r.cell, r.contig, r.kmers, r.covered) for r in found.collect()} == {(c, g, len(m), sum((c, x) in have for x in m)) for (c, g), m in want.items() if m}
    assert rows["contigs"].filter("_alone").count() >= 40
