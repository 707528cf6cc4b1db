import math
import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import bases as B
from tagloom.operators.analysis import detection_limit
from tagloom.operators.neighbours import solve_error_rate
from tagloom.operators.tables import rank_grid
from tagloom.plans.layout import check_name, compile_layout, max_offset, read_structure, slices


def one(spark, **columns):
    df = spark.range(1)
    return df.select(*[c.alias(k) for k, c in columns.items()]).first()


def test_bases(spark):
    r = one(
        spark, rc=B.reverse_complement(F.lit("ACGTNacgtnX")), f=B.folded(F.lit("acgTN?")), q=B.phreds(F.lit("!I~")), least=B.min_phred(F.lit("5I")), none=B.phreds(F.lit("")),
        bins=F.array(*[B.size_bin(F.lit(n)) for n in (1, 2, 3, 4, 1023, 1024, 1 << 40)]), cap=B.size_bin(F.lit(1 << 40), 16), h=B.hamming(F.lit("ACGTN"), F.lit("ACCTAAA")), c=B.comparable(F.lit("ACGTN"), F.lit("ACCTAAA")),
    )
    assert (r.rc, r.f) == ("NnacgtNACGT", "ACGTAA")
    assert (r.q, r.least, r.none) == ([0, 40, 60], 20, [])
    assert (r.bins, r.cap, r.h, r.c) == ([0, 1, 1, 2, 9, 10, 40], 16, 1, 4)


def test_tags_and_names(spark):
    c = F.lit("RX:Z:ACG\tQX:Z:I:I\tBC:Z:S1")
    r = one(
        spark, rx=B.tag(c, "RX"), qx=B.tag(c, "QX"), no=B.tag(c, "CB"), t=B.tags(RX=F.lit("A"), CB=F.lit(""), BC=F.lit("S")), p=B.index_pair(F.lit("1:N:0:AC+GT")), single=B.index_pair(F.lit("1:N:0:AC")), tab=B.index_pair(F.lit("1:N:0:A\tC")),
        seven=B.lane_tile(F.lit("a:1:f:3:1101:5:6")), five=B.lane_tile(F.lit("a:2:1102:5:6")), six=B.lane_tile(F.lit("a:b:c:d:e:f")), odd=B.lane_tile(F.lit("a:1:f:x:1101:5:6")),
    )
    assert (r.rx, r.qx, r.no, r.t) == ("ACG", "I:I", "", "RX:Z:A\tBC:Z:S")
    assert tuple(r.p) == ("AC", "GT") and tuple(r.single) == ("AC", "") and r.tab is None
    assert tuple(r.seven) == (3, 1101) and tuple(r.five) == (2, 1102) and r.six is None and r.odd.lane is None


def test_statistics(spark):
    r = one(spark, t=B.poisson_tail(F.lit(3), F.lit(2.0)), zero=B.poisson_tail(F.lit(0), F.lit(2.0)), low=B.poisson_interval(F.lit(10))[0], high=B.poisson_interval(F.lit(10))[1], none=B.poisson_interval(F.lit(0))[0], g=B.genome_equivalents(F.lit(3.3)))
    assert r.t == pytest.approx(1 - math.exp(-2) * 5) and r.zero == 1
    assert (r.low, r.high, r.none) == (pytest.approx(4.795, abs=0.01), pytest.approx(18.39, abs=0.02), 0.0)
    assert r.g == pytest.approx(1000)


def test_error_rate_is_recovered():
    for rate in (1e-5, 1e-3, 2e-2):
        sizes = [(1, 500), (4, 200), (30, 20)]
        t = [(n, -math.expm1(-c * rate / 3)) for c, n in sizes]
        assert solve_error_rate(sizes, 12, 36 * sum(n * (x + x * x) for n, x in t)) == pytest.approx(rate, rel=1e-6)
    assert solve_error_rate([(1, 5)], 12, -3.0) == 0


def test_rank_grid_and_detection():
    assert rank_grid(25)[:5] == [1, 2, 3, 4, 5] and rank_grid(25)[-1] == 25 and rank_grid(0) == []
    n, f = 1000, detection_limit(1000, 2)
    assert 1 - math.exp(-n * f) * (1 + n * f) == pytest.approx(0.95)


def test_layouts():
    x = compile_layout("^NNNtACGXX.r")
    assert x.anchored and x.places("umi") == [0, 1, 2] and x.places("cell") == [7, 8] and x.positions[3].weight == 0.5 and x.positions[-1].bases == "AG"
    assert slices("0:4,5:10") == "^NNNN.NNNNN" and slices("cell:0:3,4:6") == "^XXX.NN"
    assert read_structure("5M5S+T") == "^NNNNN....." and read_structure("2B3M+T") == "^XXNNN"
    assert max_offset([compile_layout("^NNA")]) == 0 and max_offset([compile_layout("NN")]) == 0 and max_offset([compile_layout("NNA")]) == -1
    for bad in ("", "ACGT", "NNQ!", "N" * 33):
        with pytest.raises(ValueError):
            compile_layout(bad)
    for bad in ("4:2", "0:4,3:6", "a:b"):
        with pytest.raises(ValueError):
            slices(bad)
    for bad in ("a/b", "..", "-x", "a\n", ""):
        with pytest.raises(ValueError):
            check_name(bad)
    assert check_name("S1") == "S1"


def test_hash_is_the_published_one():
    from tagloom.operators.sampling import packed_hash

    import numpy as np

    assert packed_hash(np.array([0], np.uint64))[0] == 0xE220A8397B1DCDAF


def test_random_hamming(spark):
    draw = random.Random(1)
    pairs = [("".join(draw.choices("ACGTN", k=12)), "".join(draw.choices("ACGTN", k=12))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", B.hamming("a", "b").alias("h"))
    assert all(r.h == sum(x != y and "N" not in (x, y) for x, y in zip(r.a, r.b)) for r in df.collect())


def test_bit_planes_compare_as_the_strings_do(spark):
    draw = random.Random(3)
    rows = [tuple("".join(draw.choices("ACGTN", k=draw.choice((1, 5, 8, 31, 32)))) for _ in "ab") for _ in range(300)] + [(None, "ACGT")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": B.planes("a"), "y": B.planes("b")})
    got = df.select(B.planes_comparable("x", "y"), B.comparable("a", "b"), B.planes_hamming("x", "y"), B.hamming("a", "b"), B.plain("a")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got) and all(r[4] for r in got[:300])
    assert not any(r[0] for r in spark.createDataFrame([("acgt",), ("ACGR",), ("A" * 33,)], "s string").select(B.plain("s")).collect())


def test_folded_barcodes(spark):
    got = spark.createDataFrame([("acgt",), ("ACGN",), ("x-",), ("",), (None,)], "s string").select(B.folded("s")).collect()
    assert [r[0] for r in got] == ["ACGT", "ACGA", "AA", "", None]
