"""The corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, BPE encoding.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next stage's docs. ORACLE_SQL is None: SQL cannot express hyperdimensional profiles,
pivotal rounding or BPE. The tests hold the stages against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, language_id, mixing, near_dedup, quality_rules, queries
from tessella.llm.common import new_path, removed, scratch, stored

#: A document whose best cosine with any language is under this is of no language learnt.
LEAST_COSINE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language, go."""
    return language_id.filtered(docs, LEAST_COSINE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays, whatever doc_ids their rows bear."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the text as decoded from its ids, and those ids and their count."""
    return bpe.encoded(docs, queries.byte_bpe(), decode=True).withColumn("n_tokens", F.size("ids"))


STAGES = [("language_id", language), ("quality_rules", quality), ("near_dedup", near_duplicates), ("source_mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage stores on its way, and its input, go once its output is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), new_path(spark, name))
        if before is not None:
            removed(spark, before)
        before = docs
    return docs
