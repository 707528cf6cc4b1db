"""The contract, and every query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tagloom import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    at = [names.index(c) for c in sorted(got.columns)]
    assert sorted(names) == sorted(got.columns)
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
