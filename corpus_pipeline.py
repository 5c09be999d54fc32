"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, the rest is encoded.

Each stage reads what the one before it kept, as a written table. The first three return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, neardup, toxicity
from lattica.llm.common import materialise, tables
from lattica.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the classifier learns from the labelled rows that aren't held out.
    Null and empty texts score as the bias alone; repeated rows score alike, and each stays or goes; a very long text is
    scored whole, by its worst window."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, tables(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id; documents without words all stay, as do
    rows without an id, and rows that share an id stay or go together."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no row, one, or several equal ones. Rows that share an id, or have
    none, are taken as often as the one of them that is taken most. Columns may have any names: a row travels as one struct."""
    copies = mixing.mix(docs.select("doc_id", "source", "text")).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"))
    taken = rows.join(copies, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, as counts and digests: a row for each row, repeats included; a null text has no ids."""
    return bpe.encode(docs, BYTE_BPE, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: The stages learn, hash and sample as SQL cannot; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
