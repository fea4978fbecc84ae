"""One query per operator over its whole table, and the SQL that DuckDB checks it against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, language_id, license_scan, mixing, near_dedup, oracles, quality_classifier, quality_rules, token_shards, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=4, percent=80)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_documents(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.prototypes(docs.where(~language_id.held_out()))
    return language_id.identified(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(_documents(spark, sf_dir), byte_bpe())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.written_and_read(_documents(spark, sf_dir), byte_bpe(), end_id=0)


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_classifier.scored(_documents(spark, sf_dir), labels)
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1,
        "op2_license_scan": op2,
        "op3_fingerprints": op3,
        "op4_language_id": op4,
        "op5_bpe_trie": op5,
        "op6_token_shards": op6,
        "op7_url_filter": op7,
        "op8_source_mixing": op8,
        "op9_quality_classifier": op9,
        "op10_quality_rules": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": oracles.NEAR_DEDUP,
        "op7_url_filter": oracles.URL_FILTER,
        "op10_quality_rules": oracles.quality_rules_sql(),
    }


