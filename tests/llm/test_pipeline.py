"""The pipeline's stages against brute force on the small table, and the queries' SQL."""

import glob
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import language_id, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_dedup", "source_mixing", "bpe"]
    now = docs
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        now = f(spark, now, sf)
        rows = now.collect()
        seen[name] = rows
        now = spark.createDataFrame(rows, now.schema)
        if name != "bpe":
            assert now.columns == docs.columns
    model = language_id.prototypes(docs.where(~language_id.held_out()))
    store = language_id.Store()

    def like(t):
        v = language_id.text_vector(t, store)
        return -1 if v is None else max(float(m @ v) / np.linalg.norm(v) for m in model.values())

    want = sorted(r["doc_id"] for r in docs.collect() if like(r["text"]) >= corpus_pipeline.LEAST_COSINE)
    assert sorted(r["doc_id"] for r in seen["language_id"]) == want
    assert {r["doc_id"] for r in seen["near_dedup"]} <= {r["doc_id"] for r in seen["quality_rules"]} <= set(want)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in seen["bpe"]:
        assert r["ids"] == t.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert len(seen["bpe"]) == len(seen["source_mixing"])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "word " * 60, "en", "s", 300), (3, "a b c " * 40, "en", "s", 3), (3, "a b c " * 40, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for d in (docs, docs.where(F.lit(False))):
        for _, f in corpus_pipeline.STAGES:
            f(spark, d, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(rel.select(*cols).fetchall(), key=str)


def test_contract_columns(spark, sf):
    want = {"op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4": "doc_id held_out lang_pred score", "op8": "doc_id size source_size target taken", "op9": "doc_id held_out score predicted", "op6": "doc_id start n_tokens ids_crc32"}
    q = {k.split("_")[0]: v for k, v in queries.queries().items()}
    assert set(q) == {f"op{n}" for n in range(1, 11)}
    for k, cols in want.items():
        df = q[k](spark, sf)
        assert df.columns[: len(cols.split())] == cols.split() and df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
