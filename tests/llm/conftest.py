import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with results."""
    made = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", None, "a", 3), (3, "word " * 30_000, "en", "a", None),
        (4, "same text again", "en", None, 1), (4, "same text again", "en", None, 1), (5, "same text again", "en", "b", 1), (6, " \t\n ", "en", "b", 1), (7, "12 !! ??", "en", "b", 1),
    ]
    df = spark.createDataFrame(made, COLUMNS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in ("score", "rank", "slot", "fp", "component_id", "verdict", "contaminated", "bucket", "_text", "key")])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con
