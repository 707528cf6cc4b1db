"""Against simulated truth, and independent of partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import barcodes, cells, consensus, correction, match, neighbours, sampling
from tagloom.sources.derived import reads as derived

SMALL = "/root/testdata/sf0.001"


def simulated(spark, molecules=600, depth=12, error=0.004, seed=3):
    draw, made = random.Random(seed), []
    payloads = ["".join(draw.choices("ACGT", k=32)) for _ in range(80)]
    for _ in range(molecules):
        umi, payload = "".join(draw.choices("ACGT", k=10)), draw.choice(payloads)
        for _ in range(max(1, int(draw.lognormvariate(math.log(depth), 0.5)))):
            seen = "".join(draw.choice("ACGT".replace(c, "")) if draw.random() < error else c for c in umi)
            read = "".join(draw.choice("ACGT".replace(c, "")) if draw.random() < 0.002 else c for c in payload)
            made.append(("S", umi, seen, "I" * 10, read, "I" * 32, payload))
    rows = [(i, *r) for i, r in enumerate(made)]
    return spark.createDataFrame(rows, "src_index long, sample_id string, umi_true string, umi string, umi_qual string, seq string, qual string, payload_true string").cache()


@pytest.fixture(scope="module")
def library(spark):
    return simulated(spark)


def test_counts_and_error_rate_are_recovered(library):
    counts = barcodes.barcode_counts(library)
    rate = neighbours.error_rate(counts).first().umi_error_rate
    assert rate == pytest.approx(0.004, rel=0.25)
    chosen = correction.parents(correction.posteriors(counts, rates=neighbours.error_rate(counts)))
    table = correction.barcode_table(counts, correction.roots(chosen)).collect()
    kept = [r for r in table if r.corrected > 0]
    assert len(kept) == pytest.approx(600, rel=0.03)
    assert sum(r.corrected for r in kept) == library.count()
    truth = {r.umi_true for r in library.select("umi_true").distinct().collect()}
    assert sum(r.key in truth for r in kept) >= 0.97 * len(kept)


def test_forest_equals_a_serial_merge(library):
    counts = barcodes.barcode_counts(library)
    chosen = correction.parents(correction.posteriors(counts, correction.Correction(error=0.004)))
    got = {r.child: r.root for r in correction.roots(chosen).collect()}
    parent = {r.child: r.parent for r in chosen.collect()}

    def end(x):
        while x in parent:
            x = parent[x]
        return x

    assert got == {c: end(c) for c in parent} and got


def posterior_by_hand(child, c, parent, p, n, space, sizes, eps, ratio=1.0):
    mean = p * eps / 3
    poisson = math.exp(-mean + c * math.log(mean) - math.lgamma(c + 1))
    f, low = c / (c + p), 1 / (p + 1)
    branch = (1 / f**2) / (1 / low - 2) * p / (c + p) ** 2 if f <= 0.5 and low < 0.5 else 0.0
    rho = min(0.9, 1e-5 * 25 * len(child))
    err = ((1 - rho) * poisson + rho * branch) * ratio
    return err / (err + n / space * max(sizes[c] / n, 1 / (n + 1)))


def test_posteriors_by_hand(library):
    counts = barcodes.barcode_counts(library)
    table = {r.key: r.cnt for r in counts.collect()}
    space = barcodes.information(barcodes.composition(counts)).first().effective_space
    sizes = {}
    for c in table.values():
        sizes[c] = sizes.get(c, 0) + 1
    want = {}
    for x, c in table.items():
        for i in range(len(x)):
            for b in "ACGT":
                y = x[:i] + b + x[i + 1 :]
                if y != x and y in table and table[y] > c and c <= 0.5 * table[y]:
                    want[x, y] = posterior_by_hand(x, c, y, table[y], len(table), space, sizes, 0.01)
    got = {(r.child, r.parent): r.posterior for r in correction.posteriors(counts, correction.Correction(error=0.01)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_payloads_help(library):
    seen = correction.evidence(library)
    share = correction.clonality(seen)
    assert share.first().clonality < 0.1
    chosen = correction.parents(correction.posteriors(seen.drop("pos_err"), rates=neighbours.error_rate(seen), agreement=share))
    roots = {r.child: r.root for r in correction.roots(chosen).collect()}
    truth = {}
    for r in library.groupBy("umi", "umi_true").count().collect():
        truth.setdefault(r.umi, []).append((r["count"], r.umi_true))
    assert sum(max(truth[c])[1] == root for c, root in roots.items()) >= 0.97 * len(roots) and len(roots) > 200


@pytest.mark.parametrize("parts", ["1", "5"])
def test_results_do_not_depend_on_partitions(spark, library, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, consensus.records(library, ("sample_id", "umi_true")).select("umi_true", "reads", "seq", "qual").collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        moved = library.repartition(int(parts) + 2, F.rand(1))
        got = sorted(map(tuple, consensus.records(moved, ("sample_id", "umi_true")).select("umi_true", "reads", "seq", "qual").collect()))
        assert got == want
        assert sorted(map(tuple, consensus.fast(moved, ("umi_true",)).collect())) == sorted(map(tuple, consensus.fast(library, ("umi_true",)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_consensus_is_the_payload(library):
    got = consensus.records(library, ("sample_id", "umi_true"), min_reads=5).collect()
    truth = {r.umi_true: r.payload_true for r in library.select("umi_true", "payload_true").distinct().collect()}
    assert sum(r.seq == truth[r.umi_true] for r in got) >= 0.99 * len(got)
    assert all(r.reads >= 5 and len(r.qual) == 32 for r in got)


def test_consensus_rules(spark):
    rows = [(0, "m", "ACGTA", "IIIII"), (1, "m", "ACG", "III"), (2, "n", "NN", "II"), (3, "t", "A", "I"), (4, "t", "C", "I")]
    got = {r.key: r for r in consensus.records(spark.createDataFrame(rows, "src_index long, key string, seq string, qual string"), ("key",)).collect()}
    assert got["m"].seq == "ACG" and got["n"].seq == "NN" and got["n"].qual == "!!" and got["t"].seq == "A"
    fast = {r.key: r for r in consensus.fast(spark.createDataFrame(rows, "src_index long, key string, seq string, qual string"), ("key",)).collect()}
    assert fast["t"].seq == "A" and fast["t"].support == 1 and fast["t"].reads == 2


def test_reads_beyond_the_cap_do_not_vote(spark):
    rows = [(i, "m", "ACGT", "I" * 4) for i in range(10)] + [(100 + i, "m", "TTTT", "I" * 4) for i in range(30)] + [(7, "n", "GG", "II")]
    df = spark.createDataFrame(rows, "src_index long, key string, seq string, qual string").repartition(3)
    got = {r.key: (r.seq, r.reads) for r in consensus.records(df, ("key",), cap=10).collect()}
    assert got == {"m": ("ACGT", 40), "n": ("GG", 1)}
    assert {r.key: r.seq for r in consensus.records(df, ("key",)).collect()} == {"m": "TTTT", "n": "GG"}
    fast = {r.key: (r.seq, r.reads, r.support) for r in consensus.fast(df, ("key",), cap=10).collect()}
    assert fast == {"m": ("ACGT", 40, 10), "n": ("GG", 1, 1)}
    assert "".join(r.base for r in consensus.columns(df.filter("key = 'm'"), ("key",), cap=10).orderBy("position").collect()) == "ACGT"


def test_batches_that_cut_molecules(spark):
    draw = random.Random(2)
    rows = [(i, f"m{i % 37}", "".join(draw.choices("ACGT", k=9)), "".join(draw.choices("#5I", k=9))) for i in range(900)]
    df = spark.createDataFrame(rows, "src_index long, key string, seq string, qual string")
    whole = sorted(map(tuple, consensus.records(df, ("key",)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    cut = sorted(map(tuple, consensus.records(df, ("key",)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r[:4] for r in cut] == [r[:4] for r in whole] and len(cut) == 37


def test_calibration_needs_two_qualities(spark):
    def fit(rows):
        return match.fit_calibration(spark.createDataFrame(rows, "position int, phred int, bases long, mismatches long")).first()

    assert (fit([(0, 30, 5000, 5)]).slope, fit([(0, 30, 5000, 5)]).intercept) == (None, None)
    two = fit([(0, 30, 5000, 10), (0, 20, 5000, 100)])
    assert two.slope == pytest.approx(2.0) and two.intercept == pytest.approx(0.0, abs=1e-9)


def test_matching(spark):
    rows = [(0, "GGAAAATACGTCCC", "I" * 14), (1, "AAAATACGTCCCGG", "I" * 14), (2, "TTTTTTTTTTTTTT", "I" * 14), (3, "AA", "II")]
    df = spark.createDataFrame(rows, "src_index long, seq string, qual string")
    got = {r.src_index: r.match for r in match.match(df, "NNNNTACGT").collect()}
    assert (got[0].offset, got[0].umi, got[0].payload_begin) == (2, "AAAA", 11) and got[1].offset == 0
    assert got[0].score == pytest.approx(5 * math.log2(4 * (1 - 1e-4)), rel=1e-6) and not got[2].found and not got[3].found
    assert not match.match(df, "NNNNTACGT", 0).filter("src_index = 0").first().match.found
    got = {r.src_index: (r.status, r["sample"]) for r in match.assign(df, {"a": "NNNNTACGT", "b": "NNNNTACGT"}, 0).collect()}
    assert got[1] == ("ambiguous", None) and got[2] == ("unmatched", None)
    assert match.assign(df, {"a": "NNNNTACGT", "b": "NNNNTCCCC"}, 0).filter("src_index = 1").first()["sample"] == "a"
    assert {r.strand for r in match.either_strand(df.limit(1).withColumn("seq", F.lit("GGGACGTATTTTCC")), "NNNNTACGT").collect()} == {"-"}
    assert match.match(df, "^NNNN", 0).filter("src_index = 2").first().match.umi == "TTTT"
    with pytest.raises(ValueError):
        match.match(df, "NNNN", -1)


def test_whitelist(spark):
    listed = spark.createDataFrame([("AAAAAAAA",), ("CCCCCCCC",)], "cell string")
    seen = [("AAAAAAAA", 100, "IIIIIIII"), ("AAAATAAA", 3, "IIII#III"), ("GGGGGGGG", 2, "IIIIIIII"), ("CCCCCCCG", 1, None)]
    got = {r.cell: r for r in cells.snap(spark.createDataFrame(seen, "cell string, reads long, first_quality string"), listed).collect()}
    assert {c: r.status for c, r in got.items()}["AAAAAAAA"] == "exact" and got["AAAATAAA"].snapped == "AAAAAAAA" and got["GGGGGGGG"].status == "far"
    assert {r.status: r.barcodes for r in cells.snap_summary(spark.createDataFrame([tuple(r) for r in got.values()], "cell string, reads long, status string, snapped string, posterior double")).collect()}["exact"] == 1


def test_subsampling_keeps_molecules_whole(spark):
    r = derived(spark, SMALL)
    some = sampling.subsample(r, 3000, "umi")
    kept = {x.umi for x in some.select("umi").distinct().collect()}
    assert some.count() == r.filter(F.col("umi").isin(list(kept))).count()
    assert 0.25 < len(kept) / r.select("umi").distinct().count() < 0.35
    assert sampling.first_barcodes(r, 50).select("umi").distinct().count() == 50 and sampling.first_reads(r, 10).count() == 10
    with pytest.raises(ValueError):
        sampling.subsample(r, 0)


def split_by_hand(reads):
    """(score, members of the smaller part) of equal-length reads, by the rule as stated."""
    width, n = min(map(len, reads)), len(reads)
    cols = []
    for j in range(width):
        counts = [sum(r[j] == b for r in reads) for b in "ACGT"]
        minor = sum(counts) - max(counts)
        if minor >= 2 and 2 * minor <= sum(counts):
            cols.append((-minor, j, "ACGT"[counts.index(max(counts))]))
    cols = sorted(cols)[:8]
    marks = [[r[j] in "ACGT" and r[j] != m for r in reads] for _, j, m in cols]

    def sf(c, a, b):
        return -math.log10(sum(math.comb(b, x) * math.comb(n - b, a - x) for x in range(c, min(a, b) + 1)) / math.comb(n, a))

    best = (0.0, None)
    for x in range(len(cols)):
        for y in range(x + 1, len(cols)):
            a, b, c = sum(marks[x]), sum(marks[y]), sum(p and q for p, q in zip(marks[x], marks[y]))
            same, other = sf(c, a, b) if c >= 2 else 0.0, sf(a - c, a, n - b) if a - c >= 2 else 0.0
            s = max(same, other) - math.log10(len(cols) * (len(cols) - 1) / 2) - math.log10(2)
            if s > best[0] + 1e-9:
                best = (s, [i for i in range(n) if marks[x][i] and marks[y][i] == (other <= same)])
    return best


def test_two_molecules_are_told_apart(spark):
    from tagloom.operators.split import split_records

    draw, rows, groups = random.Random(11), [], {}
    for g in range(25):
        one, two = ("".join(draw.choices("ACGT", k=30)) for _ in range(2))
        sizes = draw.choice(((20, 20), (30, 12), (40, 0), (5, 0), (25, 25)))
        for template, n in zip((one, two), sizes):
            for _ in range(n):
                read = "".join(draw.choice("ACGT") if draw.random() < 0.01 else c for c in template)
                groups.setdefault(g, []).append(read)
                rows.append((len(rows), f"g{g}", read, "I" * 30))
    got = {}
    for r in split_records(spark.createDataFrame(rows, "src_index long, umi string, seq string, qual string"), ("umi",)).collect():
        got.setdefault(r.umi, {})[r.molecule] = (r.reads, r.linkage)
    for g, reads in groups.items():
        score, part = split_by_hand(reads) if len(reads) >= 6 else (0.0, None)
        if score > 8.68:
            assert got[f"g{g}"][2][0] == len(part) and got[f"g{g}"][1][0] == len(reads) - len(part)
        else:
            assert set(got[f"g{g}"]) == {1}
        assert got[f"g{g}"][1][1] == pytest.approx(score, abs=1e-6)
    assert sum(len(m) == 2 for m in got.values()) >= 5


def test_suggested_layout(spark):
    from tagloom.operators.qc import cycle_profile
    from tagloom.operators.reports import suggest_layout

    draw = random.Random(12)
    rows = [(i, "".join(draw.choices("ACGT", k=6)) + "TACGT" + "".join(draw.choices("AAAAAC", k=4)), "I" * 15) for i in range(3000)]
    assert suggest_layout(cycle_profile(spark.createDataFrame(rows, "src_index long, seq string, qual string")))["layout"] == "NNNNNNtacgt"


def test_dual_layouts_and_verdicts(spark):
    rows = [(0, "AAAATACGTGGG", "I" * 12, "CCTTGCAAG", "I" * 9), (1, "AAAATACGTGGG", "I" * 12, "CCAAAAAAA", "I" * 9), (2, "NAAATACGT", "#IIIIIIII", "CCTTGCA", "I" * 7)]
    df = spark.createDataFrame(rows, "src_index long, seq string, qual string, seq2 string, qual2 string")
    both = match.dual(df, "NNNNTACGT", "NNTTGCA", 0)
    got = {r.src_index: r.match for r in both.collect()}
    assert got[0].found and got[0].umi == "AAAACC" and got[0].umi_qual == "IIIIII" and not got[1].found and got[1].umi is None
    assert {r.src_index: r.verdict for r in match.verdicts(both, min_umi_quality=10).collect()} == {0: "kept", 1: "unmatched", 2: "bad_umi"}
    assert {r.src_index: r.verdict for r in match.verdicts(both, min_payload=8).collect()} == {0: "kept", 1: "unmatched", 2: "short_payload"}
    assert [r.seq for r in match.trimmed(both).orderBy("src_index").collect()] == ["GGG", "AAAATACGTGGG", ""]
    with pytest.raises(ValueError):
        match.dual(df, "N" * 20 + "TACGT", "N" * 20 + "T")
