"""From raw documents to token files: five stages over the ``documents`` table.

Language ID drops documents that are in no learned language; SimHash keeps one of
each group of near copies (0.8 or more of their five-word shingles alike); decontamination drops documents
with benchmark passages; mixing lays the rest out so that every prefix holds the
sources' target shares; the token files follow that layout. All but the last stage
return the columns of ``documents``. Rows that repeat a doc_id and text leave one;
null and empty texts go in the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontam, langid, mixing, simhash, tokenfile
from tagloom.llm.common import discard, scratch, table, tidy
from tagloom.llm.queries import vocabulary

#: A language below this score is rejected: it is hardly more likely than a guess.
MIN_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS = 5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)), MIN_LANGUAGE_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=SHINGLE_WORDS)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of files keep their files' order; a table without files is laid out by doc_id."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return tokenfile.token_files(docs, vocabulary())
    return tokenfile.token_files(placed, vocabulary(), order=["_file", "_row"])


STAGES = [
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_to_weights),
    ("token-ID output", write_tokens),
]

#: Hashing by XXH64, fitted machines and a tokenizer are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), scratch(spark, name.split()[0].lower())
        with tidy(spark):
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
