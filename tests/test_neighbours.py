"""Pairs at distance one against comparing all with all."""

import random
from collections import Counter

import numpy as np
import pytest

from tagloom.operators import neighbours


def _keys(draw, letters, lengths, n):
    return sorted({(f"S{draw.randrange(2)}", "".join(draw.choices(letters, k=draw.choice(lengths)))) for _ in range(n)})


@pytest.mark.parametrize("letters,lengths,n", [("ACGT", (4,), 300), ("AC", (1, 5, 6, 7, 12, 13), 500), ("ACGTNRYKMSWBDHV", (3, 8), 900)])
def test_pairs_of_any_length_and_letters(spark, letters, lengths, n):
    keys = _keys(random.Random(n), letters, lengths, n)
    df = spark.createDataFrame([(s, k, i % 7 + 1) for i, (s, k) in enumerate(keys)], "sample_id string, key string, cnt long")
    want = Counter()
    for s, a in keys:
        for t, b in keys:
            if s == t and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                want[s, next(i for i, (x, y) in enumerate(zip(a, b)) if x != y) + 1, a, b] += 1
    got = Counter((r.sample_id, r.pos, r.a.key, r.b.key) for r in neighbours.neighbour_pairs(df, "cnt").collect())
    assert want and got == want
    count = dict(((s, k), i % 7 + 1) for i, (s, k) in enumerate(keys))
    larger = {r.sample_id: (r.pairs, r.wide) for r in neighbours.pair_counts(df, "cnt", wide=lambda a, b: np.maximum(a["cnt"], b["cnt"]) >= 2 * np.minimum(a["cnt"], b["cnt"])).collect()}
    wide = [(s, a, b) for s, _, a, b in want if a < b and max(count[s, a], count[s, b]) >= 2 * min(count[s, a], count[s, b])]
    assert larger == {s: (sum(w[0] == s and w[2] < w[3] for w in want), sum(w[0] == s for w in wide)) for s in {w[0] for w in want}}
    kept = neighbours.neighbour_pairs(df, "cnt", keep=lambda a, b: a["cnt"] < b["cnt"]).collect()
    assert sorted((r.sample_id, r.a.key, r.b.key) for r in kept) == sorted((s, a, b) for s, _, a, b in want if count[s, a] < count[s, b])


def test_a_barcode_is_listed_once_a_block(spark):
    """Twelve places are two rows; as one row a place, the shuffle would hold six times as many."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows, i, j, pos):
        seen.add(rows.num_rows)

    keys = sorted({"".join(random.Random(i).choices("ACGT", k=3)) + "A" * 9 for i in range(200)})
    df = spark.createDataFrame([("S", k) for k in keys], "sample_id string, key string")
    neighbours.in_groups(df, (), count, "n long").collect()
    assert len(keys) <= seen.value <= 2 * len(keys)


def test_groups_that_cross_batches(spark):
    keys = [(a, a + b) for a in ("ACGTAC", "CCCCCC") for b in ("".join(x) for x in _words(6))]
    df = spark.createDataFrame([("S", k) for _, k in keys], "sample_id string, key string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert neighbours.census(df).first().pairs == 2 * 4096 * 18 // 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _words(n):
    return [()] if not n else [(c, *w) for c in "ACGT" for w in _words(n - 1)]


def test_reads_are_placed_as_one_by_one():
    from tagloom.operators.studies import best_places

    draw, ref = random.Random(3), "ACGTTGCAAGCTTACGGATCC"
    turn = str.maketrans("ACGTN", "TGCAN")
    seqs = ["".join(draw.choices("ACGTN", k=draw.choice((0, 3, 8, 21, 22)))) for _ in range(300)]

    def by_hand(s):
        found = (None, None, None)
        for strand, text in (("+", s), ("-", s[::-1].translate(turn))):
            for at in range(len(ref) - len(s) + 1) if s else ():
                n = sum(a != b for a, b in zip(text, ref[at:]))
                if found[2] is None or n < found[2]:
                    found = (strand, at, n)
        return found

    assert list(zip(*best_places(seqs, ref))) == [by_hand(s) for s in seqs]


def test_majority_moves_no_row_a_position(spark):
    from tagloom.operators.studies import majority

    rows = [("a", "ACGT"), ("a", "ACGT"), ("a", "ACTTA"), ("b", "AC"), ("b", "AG"), ("c", "GATTACA"), ("d", ""), ("e", "NA"), ("e", "NC"), ("e", "TC")]
    called = majority(spark.createDataFrame(rows, "m string, seq string"), ("m",))
    assert {(r.m, r.position): (r.reads, r.base) for r in called.collect()} == {
        **{("a", i + 1): (3, c) for i, c in enumerate("ACGT")}, ("b", 1): (2, "A"), ("b", 2): (2, "N"), **{("c", i + 1): (1, c) for i, c in enumerate("GATTACA")}, ("e", 1): (3, "N"), ("e", 2): (3, "C"),
    }
    plan = called._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generate = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any("Aggregate" in line for line in plan[:generate])
