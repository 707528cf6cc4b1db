"""Splitting on bit matrices, and its curveball null."""

import random
from collections import Counter
from itertools import combinations, product

import numpy as np

from tagloom.operators import nulls, split
from tagloom.operators.contigs import _offset, place


def test_chain_against_all_matrices_of_its_margins():
    bits = np.array([[1, 1, 0, 0], [1, 0, 1, 0], [0, 1, 1, 0], [1, 0, 0, 1], [0, 0, 1, 0]], bool)
    options = [list(combinations(range(4), int(n))) for n in bits.sum(axis=1)]
    every = {m for m in product(*options) if [sum(c in r for r in m) for c in range(4)] == bits.sum(axis=0).tolist()}
    chains = 40 * len(every)
    rows = nulls.curveball(np.tile(nulls._words(bits), (chains, 1)), 4, 200, nulls._hashed(np.arange(chains, dtype=np.uint64)))
    seen = Counter(tuple(tuple(c for c in range(4) if w >> c & 1) for w in row.tolist()) for row in rows)
    assert set(seen) == every and len(every) > 20
    assert sum((n - 40) ** 2 / 40 for n in seen.values()) < len(every) + 4 * (2 * len(every)) ** 0.5  # chi-square of an even spread
    scores = Counter(round(s, 6) for s in nulls.null_scores([bits], [7], chains)[0])
    exact = Counter(round(split.best_pair(split.shared(np.array([[c in r for c in range(4)] for r in m])), 5)[0], 6) for m in every)
    for score, n in exact.items():
        assert abs(scores[score] / chains - n / len(every)) < 0.05


def test_margins_stay():
    draw = np.random.default_rng(3)
    bits = draw.random((60, 8)) < draw.random((60, 1)) * 0.5
    for row in nulls.curveball(np.tile(nulls._words(bits), (5, 1)), 8, 1200, np.arange(5, dtype=np.uint64)):
        out = (row[:, None] >> np.arange(8)) & 1
        assert (out.sum(axis=0) == bits.sum(axis=0)).all() and (out.sum(axis=1) == bits.sum(axis=1)).all()


def _reads(spark, groups=30):
    draw, rows = random.Random(5), []
    for g in range(groups):
        templates = ["".join(draw.choices("ACGT", k=30)) for _ in range(1 + g % 2)]
        for i in range(40):
            rows.append((len(rows), f"S{g % 2}", f"g{g}", "".join(draw.choice("ACGT") if draw.random() < 0.06 else c for c in templates[i % len(templates)]), "I" * 30))
    return spark.createDataFrame(rows, "src_index long, sample_id string, umi string, seq string, qual string")


def test_null_is_the_same_however_molecules_are_dealt(spark):
    df = _reads(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, nulls.linkage_scores(df.repartition(int(n)), repeats=5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 30
    other = sorted(map(tuple, nulls.linkage_scores(df, repeats=5, seed=2).collect()))
    assert [r[:3] for r in other] == [r[:3] for r in found[0]] and other != found[0]


def test_null_separates_two_molecules_from_bad_reads(spark):
    scores = nulls.linkage_scores(_reads(spark), repeats=10)
    rows = {(r.sample_id, r.target): r for r in nulls.linkage_null(scores).collect()}
    one, two = rows["S0", 0.05], rows["S1", 0.05]
    assert one.molecules == two.molecules == 15 and one.randomisations == 150
    assert two.called == 15 and two.fraction == 1.0 and one.called <= 4
    for r in rows.values():
        assert r.low <= r.threshold <= r.high
    null = sorted(s for r in scores.filter("sample_id = 'S0'").collect() for s in r.null)
    assert abs(one.threshold - null[round(0.95 * 149)]) <= 0.001


def test_molecules_out_of_bounds_take_no_part(spark):
    df = _reads(spark, 2)
    assert nulls.linkage_scores(df, max_reads=39).count() == 0 == nulls.linkage_scores(df.limit(0)).count()
    assert nulls.linkage_null(nulls.linkage_scores(df.limit(0))).count() == 0


def pairwise(seqs):
    """Reads joined pair by pair, every pair looked at."""
    parent, shift = list(range(len(seqs))), [0] * len(seqs)

    def root(i):
        at = 0
        while parent[i] != i:
            at += shift[i]
            i = parent[i]
        return i, at

    for i in range(len(seqs)):
        for j in range(i + 1, len(seqs)):
            (a, x), (b, y) = root(i), root(j)
            if a != b and (offset := _offset(seqs[i], seqs[j])) is not None:
                parent[b], shift[b] = a, x + offset - y
    groups = {}
    for i in range(len(seqs)):
        a, x = root(i)
        groups.setdefault(a, []).append((i, x))
    return sorted(([(i, x - min(y for _, y in g)) for i, x in g] for g in groups.values()), key=lambda g: (-len(g), min(seqs[i] for i, _ in g)))


def test_placement_by_the_word_index_against_all_pairs():
    for seed in range(40):
        draw = random.Random(seed)
        bases = [bytes(draw.choices(b"ACGT", k=draw.choice((60, 120)))) for _ in range(draw.randint(1, 4))] + [b"A" * 70, b"ACACACACACACGT" * 6]
        seqs = []
        for _ in range(draw.randint(0, 60)):
            base = draw.choice(bases)
            at = draw.randrange(len(base) - 30)
            read = bytearray(base[at : at + draw.randint(0, 60)])
            for _ in range(draw.randint(0, 2) if read else 0):
                read[draw.randrange(len(read))] = draw.choice(b"ACGTN")
            seqs.append(bytes(read))
        assert place(seqs) == pairwise(seqs), seed


def test_offset_counts_repeated_words_of_the_other_read():
    draw = random.Random(2)
    unit = bytes(draw.choices(b"ACGT", k=20))
    assert _offset(unit + b"A" * 20, unit * 3) in (0, -20, -40) and _offset(unit * 2, unit * 2) == 0
    assert _offset(unit, bytes(draw.choices(b"ACGT", k=40))) is None


def test_deep_molecules_are_placed_in_time():
    import time

    draw = random.Random(1)
    base = bytes(draw.choices(b"ACGT", k=3000))
    begin = time.process_time()
    unrelated = [bytes(draw.choices(b"ACGT", k=60)) for _ in range(10_000)]
    tiles = [base[at : at + 100] for at in (draw.randrange(2900) for _ in range(10_000))]
    assert len(place(unrelated)) > 9_900 and len(place(tiles)) == 1
    assert time.process_time() - begin < 20
