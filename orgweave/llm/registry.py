"""The contract queries: each reads its whole table, applies its operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bayes, bpe, jaccard, logindex, mtree, packing, quality, shards, suffix, urls

#: Folder of the public tokenizer files; None: that of the installed package.
TOKENIZER_DIR: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.read_slots(shards.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logindex.substring_dedup(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_quality_rules, op4_token_shards, op5_quality_classifier, op6_url_filters, op7_best_fit_packing, op8_substring_dedup, op9_exact_top_k, op10_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix.SQL, "op3_quality_rules": quality.sql(), "op6_url_filters": urls.sql(), "op8_substring_dedup": logindex.SQL, "op9_exact_top_k": mtree.SQL, "op10_ngram_jaccard_join": jaccard.SQL}
