"""The opN_ queries and the pipeline over the smallest tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lattica.llm import bpe, mixing, neardup, queries, toxicity

DATA = __spark_entry__.DATA
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_columns(spark):
    want = {
        "op1_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}, "op2_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op7_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op9_nearest": {"query_id", "rank", "vec_id", "score"},
    }
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, columns in want.items():
        got = queries.queries()[name](spark, DATA)
        assert columns <= set(got.columns), name
        if name != "op9_nearest":
            assert got.count() == documents, name


def test_held_out(spark):
    rows = queries.op6_toxicity(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_pipeline_stages(spark):
    """Each stage against its operator's own decisions on the same input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if name == "toxicity":
            assert ids == sorted(i for i, s in scores.items() if s < toxicity.THRESHOLD)
        elif name == "near_dedup":
            assert ids == sorted(r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()) and len(set(ids)) == len(ids)
        else:
            assert ids == sorted(r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies))
    want = sorted(map(tuple, bpe.encode(kept, queries.BYTE_BPE, with_ids=False).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_pipeline_on_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", None, 5), (4, "a b c", "en", "a", 5), (None, "z z", "en", "a", 3)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 3]
    again = docs.unionByName(docs)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.drop_near_duplicates(spark, again, str(tmp_path)).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert all(n % 2 == 0 for n in (corpus_pipeline.mix_sources(spark, again, str(tmp_path)).groupBy("doc_id").count().toPandas()["count"]))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").where(F.lit(True)).count() == 0
