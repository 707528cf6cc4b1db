"""The matcher over batches against a plain scan of one read at a time."""

import math
import random

import numpy as np
import pytest

from tagloom.operators import match
from tagloom.plans.layout import compile_layout

SCHEMA = "src_index long, seq string, qual string"


def single(x):
    return float(np.float32(x))


def scan(layout, seq, qual, most=-1, n_layouts=1):
    """(score, offset, margin) of the best placement, or None; scores in single precision."""
    layout = compile_layout(layout)
    last = len(seq) - len(layout.positions)
    last = min(last, most) if most >= 0 else last
    if last < 0:
        return None
    scores = []
    for o in range(last + 1):
        total = 0.0
        for i, p in enumerate(layout.positions):
            if p.kind == "scored":
                q = 30 if not qual else min(max(ord(qual[o + i]) - 33 if o + i < len(qual) else 0, 0), 60)
                e, n = 10 ** (-q / 10), len(p.bases)
                hit = (1 - e) / n + (n - 1) * e / (3 * n)
                total += single(math.log2(4 * hit) if hit > 0 else -math.inf) if seq[o + i].upper() in p.bases else p.weight * single(math.log2(4 * max(e, 1e-6) / 3))
        scores.append(total)
    best = max(scores)
    rest = [s for i, s in enumerate(scores) if i != scores.index(best)]
    margin = best - max(rest) if rest else best
    if layout.places("scored") and best < math.log2((last + 1) * n_layouts / 0.01):
        return None
    return best, scores.index(best), margin


def assigned(sheet, seq, qual, most):
    found = [(s[0], -i, n, s) for i, (n, text) in enumerate(sheet) if (s := scan(text, seq, qual, most, len(sheet)))]
    found.sort(key=lambda f: f[:2], reverse=True)
    if not found:
        return "unmatched", None
    if len(found) > 1 and found[0][0] - found[1][0] < 5.0:
        return "ambiguous", None
    return "assigned", found[0][2]


def drawn(seed, layouts, n=300):
    draw, rows = random.Random(seed), []
    for i in range(n):
        body = "".join(draw.choice(p.bases or "ACGT") for p in compile_layout(draw.choice(layouts)).positions)
        seq = "".join(draw.choices("ACGTN", k=draw.randint(0, 6))) + body + "".join(draw.choices("ACGTacgt", k=draw.randint(0, 30)))
        seq = "".join(draw.choice("ACGTN") if draw.random() < 0.05 else c for c in seq)
        seq = seq[: draw.randint(0, len(seq))] if draw.random() < 0.1 else seq
        qual = "".join(draw.choice("!#+5?IZ") for _ in seq)
        rows.append((i, seq, draw.choice([qual, qual, qual, "", None, qual[: len(qual) // 2]])))
    return rows


@pytest.mark.parametrize("most", [-1, 0, 4])
def test_match_against_a_plain_scan(spark, monkeypatch, most):
    layout = "NNNNXXtRCGTWac.BNN"
    rows = drawn(most + 9, [layout]) + [(900, None, None), (901, "", ""), (902, "é" * 40, "I" * 40), (903, "ACGT" * 500, "I" * 2000)]
    monkeypatch.setattr(match, "CELLS", 500)
    df = spark.createDataFrame(rows, SCHEMA)
    for r, (_, seq, qual) in zip(match.match(df, layout, most).orderBy("src_index").collect(), rows):
        want = scan(layout, seq or "", qual, most)
        assert r.match.found == (want is not None), (seq, qual)
        if want:
            assert (r.match.score, r.match.offset, r.match.margin) == want
            at = want[1]
            assert r.match.umi == seq[at : at + 4] + seq[at + 16 : at + 18] and r.match.cell == seq[at + 4 : at + 6] and r.match.payload_begin == at + 18
            assert r.match.cell_qual == ((qual + "!" * 99)[at + 4 : at + 6] if qual else "??")
        else:
            assert r.match.score is None and r.match.umi is None


@pytest.mark.parametrize("most", [-1, 0])
def test_assignment_over_a_sheet(spark, most):
    draw = random.Random(4)
    sheet = [(f"S{i}", "NNNN" + "".join(draw.choices("ACGT", k=9)) + "t") for i in range(40)]
    sheet += [("near", sheet[0][1][:-2] + ("A" if sheet[0][1][-2] != "A" else "C") + "t"), ("same", sheet[1][1]), ("long", "N" * 30 + "ACGTACGT")]
    rows = drawn(3, [text for _, text in sheet])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.src_index: (r.status, r["sample"]) for r in match.assign(df, dict(sheet), most).collect()}
    want = {i: assigned(sheet, seq, qual, most) for i, seq, qual in rows}
    assert got == want and len({s for s, _ in want.values()}) == 3


def test_plan_does_not_grow_with_the_sheet(spark):
    df = spark.createDataFrame([(0, "ACGTACGTACGT", "I" * 12)], SCHEMA)
    small = match.assign(df, {"a": "NNACGTACGT"}, 0)._jdf.queryExecution().toString()
    large = match.assign(df, {f"s{i}": "NN" + "".join("ACGT"[i // 4**k % 4] for k in range(8)) for i in range(1000)}, 0)._jdf.queryExecution().toString()
    assert abs(len(large) - len(small)) < 300


def test_demultiplexed_reads_face_one_way(spark):
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    read = "AAAATACGTCCGGG"
    df = spark.createDataFrame([(0, read, "ABCDEFGHIJKLMN"), (1, turn(read), "NMLKJIHGFEDCBA"), (2, "T" * 14, "I" * 14)], SCHEMA)
    got = match.demultiplex(df, [{"sample": "a", "pattern": "NNNNTACGT", "slave": None}]).orderBy("src_index").collect()
    assert [(r.status, r["sample"], r.normalised, r.seq, r.qual) for r in got] == [("assigned", "a", False, read, "ABCDEFGHIJKLMN"), ("assigned", "a", True, read, "ABCDEFGHIJKLMN"), ("unmatched", None, False, "T" * 14, "I" * 14)]
    with pytest.raises(ValueError, match="needs a second mate"):
        match.demultiplex(df, [{"sample": "a", "pattern": "NNNNTACGT", "slave": "NNACGT"}])


def test_two_close_samples_are_not_looked_for_on_the_mate(spark):
    df = spark.createDataFrame([(0, "AAAATACGTCC", "I" * 11, "CCCCGATTACA", "I" * 11), (1, "GGGGGGGGGGG", "I" * 11, "CCCCGATTACA", "I" * 11)], SCHEMA + ", seq2 string, qual2 string")
    sheet = [{"sample": "a", "pattern": "NNNNTACGT"}, {"sample": "b", "pattern": "NNNNTACGT"}, {"sample": "c", "pattern": "NNNNGATTACA", "slave": "GGGGGGGnn"}]
    got = match.demultiplex(df, sheet, 0).orderBy("src_index").collect()
    assert [(r.status, r["sample"], r.normalised) for r in got] == [("ambiguous", None, False), ("assigned", "c", True)]
    assert (got[1].match.umi, got[1].seq, got[1].seq2) == ("CCCCGG", "CCCCGATTACA", "GGGGGGGGGGG")
