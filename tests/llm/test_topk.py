import math
import random

from pyspark.sql import functions as F

from pyspark.errors import PythonException
import pytest

from tagloom.llm import topk
from tagloom.llm.oracles import oracle_sql
from tagloom.llm.queries import op3_exact_topk
from tagloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def by_hand(rows, k):
    usable = [(i, tuple(math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scored = {}
    for q, v in {(q, v) for q, v in usable if q % 100 == 0}:
        scored.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
    return sorted((q, n, i, -s) for q, found in scored.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_against_all_pairs(spark, monkeypatch):
    draw = random.Random(3)
    f = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f(draw.gauss(0, 1)) for _ in range(20)], "x") for i in range(400)]
    rows += [(400 + i, rows[7][1], "x") for i in range(150)]  # one very common vector
    rows += [(1000, [1.0, None] + [0.0] * 18, "x"), (1100, None, "x"), (1200, [math.nan] * 20, "x"), (1300, [math.inf] * 20, "x"), (1400, [], "x"), (1401, [], "x"), (None, rows[0][1], "x")]
    rows += [(1500, [1.0, 2.0], "x"), (1501, [3.0, 4.0], "x"), rows[0], rows[300]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(top_k(df, F.col("vec_id") % 100 == 0, 10)) == by_hand(rows, 10)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 40)  # two queries a pass
    monkeypatch.setattr(topk, "SAMPLE", 5)
    assert result(top_k(df.repartition(5), F.col("vec_id") % 100 == 0, 10)) == by_hand(rows, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e5 + i, -3e5 + 7 * i, 2.5e5], "x") for i in range(130)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert result(top_k(df, F.col("vec_id") % 100 == 0, 5)) == by_hand(rows, 5)


def test_scores_beyond_doubles(spark):
    """Scores between 2^53 and 2^63 are exact, larger ones an error; huge components count where a product is small."""
    rows = [(0, [3.0, 1.0], "x"), *((i, [1e11 + i / 7, -2e11], "x") for i in range(1, 40)), (100, [1e11, 1.0], "x"), (200, [0.0, 5.0], "x"), (201, [1e300, 2.0], "x")]
    schema = SCHEMA.replace("float", "double")
    fit = [r for r in rows if r[0] not in (100, 201)]
    assert result(top_k(spark.createDataFrame(fit, schema), F.col("vec_id") % 100 == 0, 45)) == by_hand(fit, 45)
    only = [rows[-2], rows[-1], rows[3]]
    assert result(top_k(spark.createDataFrame(only, schema), F.col("vec_id") % 100 == 0, 2)) == by_hand(only, 2)
    for pair in (((0, [1e17, 1.0]), (1, [2e17, 1.0])), ((0, [1e300]), (1, [1e300]))):
        with pytest.raises(PythonException, match="does not fit a long"):
            top_k(spark.createDataFrame([(i, v, "x") for i, v in pair], schema), F.col("vec_id") % 100 == 0).collect()


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (5, [3.0, 1.0], "x"), (5, [3.0, 1.0], "x"), (5, [4.0, 1.0], "x"), (7, [0.5, 0.5], "x")]
    assert result(top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)) == by_hand(rows, 10)


def test_empty_and_few(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0], "x")], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_query_against_sql(spark, small, duck):
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in op3_exact_topk(spark, small).collect()}
    want = set(duck.execute(f"select query_id, rank, vec_id, score from ({oracle_sql()['op3_exact_topk']})").fetchall())
    assert got == want
