"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

#: The filter's rules: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score

    held_out = fold("doc_id", 7, 2)
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5, 0)
    found = identify(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import SIGNALS, fit, score

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4, 2)
    found = score(docs, fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", *SIGNALS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import importance

    return importance(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    numbered = (
        op1_mix_sources, op2_hpylm, op3_exact_topk, op4_language_id, op5_toxicity, op6_simhash, op7_quality, op8_decontaminate, op9_token_files, op10_url_filter,
        op11_block_max, op12_spelling_variants, op13_jaccard_join,
    )
    return {f.__name__: f for f in numbered}
