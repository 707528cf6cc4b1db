"""Presets, sinks, contigs, reports and studies against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import consensus, contigs, qc, reports, studies
from tagloom.plans import presets
from tagloom.sources import sinks

SEQ = "src_index long, key string, seq string, qual string"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_presets():
    assert presets.preset("10x")[0].count("X") == 16 and presets.recipe(" cfDNA")["assay"] == "ctdna"
    assert presets.recipe("vdj") == {"assay": "10x-vdj", "layout": presets.PRESETS["10x-v2"][0], "slave": None, "also": ("10x",), "min_reads": 1, "pre_amp": "rt", "use_payload": True, "fast": False, "contig": True}
    for name, (master, slave) in presets.PRESETS.items():
        assert presets.describe([{"sample": name, "pattern": master, "slave": slave}])[0]["umi"] + master.count("X") > 0
    assert presets.describe([{"sample": "d", "pattern": presets.PRESETS["duplex"][0], "slave": presets.PRESETS["duplex"][1]}])[0]["umi"] == 24
    assert presets.inline_sheet("^XXXXNNNN", "S1")[0]["sample"] == "S1"
    for bad in (lambda: presets.preset("none"), lambda: presets.recipe("none"), lambda: presets.inline_sheet("CCCCCCNNNN", "S"), lambda: presets.describe([{"sample": "s", "pattern": "ACGT", "slave": None}])):
        with pytest.raises(ValueError):
            bad()


def test_pre_amp_and_options():
    assert [consensus.parse_pre_amp(x) for x in ("auto", "rt", "medium", "high", "0.01")] == [None, 1e-4, 1e-5, 1e-6, 0.01]
    for bad in ("0", "1", "much"):
        with pytest.raises(ValueError):
            consensus.parse_pre_amp(bad)
    consensus.check_options(contig=True)
    for bad in ({"fast_mode": True, "contig": True}, {"mate2": True}, {"limit": 5, "from_counts": True}):
        with pytest.raises(ValueError):
            consensus.check_options(**bad)


def test_samples_keep_the_empty_ones(spark, tmp_path):
    rows = [(i, "assigned" if i % 3 else "unmatched", "one" if i % 3 else None, "ACGT") for i in range(30)]
    df = spark.createDataFrame(rows, "src_index long, status string, sample string, seq string").withColumn("match", F.lit("x"))
    at = str(tmp_path / "out")
    assert {(r.sample_id, r.reads) for r in sinks.write_samples(df, at, ["one", "two", "one"]).collect()} == {("one", 20), ("two", 0)}
    assert sinks.read_sample(spark, at, "one").count() == 20 and sinks.read_sample(spark, at, "two").count() == 0
    for name in (None, "three"):
        with pytest.raises(ValueError):
            sinks.read_sample(spark, at, name)
    sinks.write_unmatched(df, str(tmp_path / "rest"))
    assert {r.status for r in spark.read.parquet(str(tmp_path / "rest")).collect()} == {"unmatched"}
    sinks.write_table(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), str(tmp_path / "t"), ["n"])
    assert next((tmp_path / "t").glob("part-*")).read_text() == "n\ts\n1\ta\n2\tb\n"
    sinks.write_table(spark.createDataFrame([(2, "b")], "n int, s string"), str(tmp_path / "j"), ["n"], as_json=True)
    assert json.loads(next((tmp_path / "j").glob("part-*")).read_text()) == {"n": 2, "s": "b"}


def test_contigs_put_fragments_together(spark):
    draw = random.Random(1)
    one, two = ("".join(draw.choices("ACGT", k=n)) for n in (120, 70))
    made = [("m", one[i : i + 50]) for i in (0, 20, 40, 70)] + [("m", two[:45]), ("m", two[20:])] + [("n", "ACGT" * 3)]
    rows = [(i, k, s, "I" * len(s)) for i, (k, s) in enumerate(made)]
    got = [(r.key, r.contig, r.contigs, r.reads, r.seq) for r in contigs.contigs(spark.createDataFrame(rows, SEQ), ("key",)).orderBy("key", "contig").collect()]
    assert got == [("m", 1, 2, 4, one), ("m", 2, 2, 2, two), ("n", 1, 1, 1, "ACGT" * 3)]


def test_mates_are_merged_where_they_overlap(spark):
    draw, rows, want = random.Random(2), [], {}
    for g in range(12):
        whole = "".join(draw.choices("ACGT", k=90))
        a, b = whole[:60], whole[30:] if g % 3 else whole[75:] + "".join(draw.choices("ACGT", k=40))
        want[f"g{g}"] = [whole] if g % 3 else [a, b]
        for _ in range(3):
            rows.append((len(rows), f"g{g}", a, "I" * len(a), turned(b), "I" * len(b)))
    df = spark.createDataFrame(rows, SEQ + ", seq2 string, qual2 string")
    got = {}
    for r in contigs.merged_mates(df, ("key",)).orderBy("key", "contig").collect():
        got.setdefault(r.key, []).append(r.seq)
        assert r.reads == 3 and r.contigs == len(want[r.key])
    assert got == want


def test_pre_amplification_floor_is_recovered(spark):
    draw, rows = random.Random(3), []
    family = "".join(draw.choices("ACGT", k=60))
    for i in range(3000):
        seq = "".join(draw.choice("ACGT".replace(c, "")) if draw.random() < 1e-3 else c for c in family)
        rows.append(("S", 25, seq))
    rows += [("T", 25, family)] * 50 + [("U", 3, family)] * 500
    got = {r.sample_id: r for r in consensus.pre_amp_floor(spark.createDataFrame(rows, "sample_id string, reads long, seq string")).collect()}
    assert got["S"].ci_lo < 1e-3 < got["S"].ci_hi and got["S"].used == got["S"].rate and not got["S"].fallback
    assert (got["T"].used, got["T"].reason) == (1e-4, "too few deep molecules") and got["U"].molecules_deep == 0


def test_stitching_and_notes():
    adapter = "ACGTTGCAAGCTTACG"
    mers = [(adapter[i : i + 8], 100 - i) for i in range(len(adapter) - 7)]
    assert qc.stitched([mers[4], *mers]) == adapter
    assert qc.stitched([("AAAAAAAA", 50), ("CCCCCCCC", 40)]) == "" and qc.stitched([]) == ""
    notes = [reports.layout_note(*x) for x in ((0, 0, 5), (0, 0, 0), (8, 10, 4), (8, 0, 0), (40, 10, 0), (8, 31, 0), (8, 10, 0))]
    assert notes == ["unanchored", "no_barcode", "more_after_anchor", "no_anchor", "barcode_too_long", "long_anchor", ""]


def test_labels_and_frequencies(spark):
    df = spark.createDataFrame([("WT_20ng_30x_rep2", "DP=4;AF=0.25;X=1"), ("odd", "DP=4")], "label string, info string")
    rows = df.select(studies.run_label("label").alias("l"), studies.allele_frequency("info").alias("af")).collect()
    assert [(r.l.input_ng, r.l.depth, r.l.replicate, r.af) for r in rows] == [(20.0, 30.0, 2, 0.25), (None, None, None, None)]


def test_shuffled_columns_keep_their_letters(spark):
    draw = random.Random(4)
    keys = ["".join(draw.choices("ACGT", [5, 3, 1, 1], k=6)) for _ in range(400)]
    df = spark.createDataFrame([("S", k, 1) for k in set(keys)], "sample_id string, key string, cnt long")
    got = [r.key for r in studies.column_shuffled(df, 1).collect()]
    assert len(got) == len(set(keys)) and all(sorted(g[i] for g in got) == sorted(k[i] for k in set(keys)) for i in range(6)) and sorted(got) != sorted(set(keys))
    null = studies.divergence_null(df, shuffles=3).first()
    assert null.js >= 0 and null.null_mean >= 0
    pairs = studies.neighbour_null(df).first()
    assert pairs.pairs > 0 and pairs.chance_pairs > 0 and pairs.ratio_pairs == 0


def test_split_power(spark):
    records = spark.createDataFrame([("S", "a", 1, 5), ("S", "a", 2, 4), ("S", "b", 1, 9), ("S", "c", 1, 3)], "sample_id string, umi string, molecule int, reads long")
    truth = spark.createDataFrame([("S", "a", 1), ("S", "a", 2), ("S", "b", 3), ("S", "b", 4), ("S", "c", 5)], "sample_id string, umi string, molecule int")
    assert [(r.depth_bin, r.mixed, r.split, r.power) for r in studies.split_power(records, truth).collect()] == [(3, 2, 1, 0.5)]


def test_all_contigs_of_a_batch_are_called_at_once(spark, monkeypatch):
    """Mates of many molecules, some without overlap, some empty: the calls of each molecule by itself, in one call a batch."""
    draw, made = random.Random(8), []
    for g in range(30):
        whole = "".join(draw.choices("ACGT", k=90))
        a, b = [(whole[:60], whole[30:]), (whole[:50], whole[60:]), ("", whole[:40]), ("", ""), (whole[40:80], whole[20:70])][g % 5]
        for _ in range(draw.randint(1, 12)):
            one, two = ("".join(draw.choice("ACGTN") if draw.random() < 0.03 else c for c in x) for x in (a, b))
            made.append((g, one, "".join(draw.choices("!+5?I", k=len(one))), two, "".join(draw.choices("!+5?I", k=len(two)))))
    calls = []
    plain = contigs.call_columns
    monkeypatch.setattr(contigs, "call_columns", lambda *a: calls.append(1) or plain(*a))
    want = []
    for g in range(30):
        own = [m[1:] for m in made if m[0] == g]
        offset = contigs.merge_offset([m[0] for m in own], [m[2] for m in own])
        firsts, seconds = [(m[0].encode(), m[1].encode()) for m in own], [(m[2].encode(), m[3].encode()) for m in own]
        low = min(0, offset or 0)
        parts = [[(m, -low) for m in firsts] + [(m, offset - low) for m in seconds]] if offset is not None else [[(m, 0) for m in x] for x in (firsts, seconds)]
        for part in parts:
            if any(m[0] for m, _ in part):
                seq, qual, error, quality = contigs._called([m[0] for m, _ in part], [m[1] for m, _ in part], [(i, x) for i, (_, x) in enumerate(part)], contigs.FLOOR)
                want.append((g, len(own), len(parts), seq, qual, round(error, 9), round(quality, 9)))
    calls.clear()
    ran = []
    monkeypatch.setattr(contigs, "by_molecule", lambda votes, keys, run, schema: ran.append(run) or votes)
    contigs.merged_mates(spark.createDataFrame([(0, "k", "A", "I", "A", "I")], SEQ + ", seq2 string, qual2 string"), ("key",))
    starts = [i for i, m in enumerate(made) if not i or m[0] != made[i - 1][0]]
    which, columns = ran[0]([f"{m[1]}|{m[3]}".encode() for m in made], [f"{m[2]}!{m[4]}".encode() for m in made], contigs.np.array(starts))
    reads, _, n, seq, qual, error, quality = (c.to_pylist() for c in columns)
    assert [(g, r, k, s, q, round(e, 9), round(m, 9)) for g, r, k, s, q, e, m in zip(which, reads, n, seq, qual, error, quality)] == want
    assert len(calls) == 1


def test_pre_amplification_floor_goes_through_molecules_once(spark, tmp_path):
    """Molecules are made by a task that notes each run; those alike are one row and a number."""
    rows = [("S", 25, "ACGT" * 15)] * 400 + [("S", 2, "ACGT")] * 400 + [("T", 1, "A")] * 5 + [(None, 30, "AC")]

    def noted(batches):
        (tmp_path / str(random.random())).touch()
        yield from batches

    df = spark.createDataFrame(rows, "sample_id string, reads long, seq string").coalesce(1)
    got = {r.sample_id: r for r in consensus.pre_amp_floor(df.mapInArrow(noted, df.schema)).collect()}
    assert (got["S"].molecules_deep, got["S"].molecules_scored, got["S"].bases, got["S"].mismatches, got["T"].molecules_deep) == (400, 400, 24_000, 0, 0)
    assert len(list(tmp_path.iterdir())) == 1
