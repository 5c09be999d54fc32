"""Graphs, features and weights derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.order import number_rows
from .sources.scratch import scratch  # noqa: F401

#: Features of a vertex in the tables; neighbours in a fixed-degree sequence; the modulus that leaves vertices isolated.
WIDTH, NEIGHBOURS, GAP = 64, 16, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))


def size(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def _pairs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """dst, src of every row of lineitem, of n vertices."""
    part = F.col("l_partkey") % n
    dst = part - F.when(part % GAP == 3, 1).otherwise(0)  # every row is an edge, and some vertices receive none
    return table(spark, sf_dir, "lineitem").select(dst.alias("dst"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("src"))


def plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dst, src, val: distinct pairs with their multiplicity."""
    return _pairs(spark, sf_dir, size(spark, sf_dir)).groupBy("dst", "src").agg(F.count("*").cast("double").alias("val"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, dst, src, val: the same in CSR order. Until they are numbered, both ends are one long (nulls first, n up to
    1.5e9), as Spark counts and ships that in half the bytes, and sorts by a single number without comparing rows."""
    n = size(spark, sf_dir)
    place = lambda end: F.coalesce(F.col(end), F.lit(-n)) + n  # noqa: E731  # ends lie between -n and n
    both = _pairs(spark, sf_dir, n).select((place("dst") * F.lit(2 * n).cast("long") + place("src")).alias("both"))
    numbered = number_rows(both.groupBy("both").agg(F.count("*").cast("double").alias("val")), "both", "eid")
    end = lambda x: F.nullif(F.expr(x) - n, F.lit(-n).cast("long"))
    return numbered.select("eid", end(f"both DIV {2 * n}").alias("dst"), end(f"both % {2 * n}").alias("src"), "val")


def features(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """v, feat: embeddings rounded to 1/1024, so that sums are exact in any order."""
    rounded = F.transform(F.slice("embedding", 1, width), lambda x: F.round(x.cast("double") * 1024) / 1024)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), rounded.alias("feat"))


def tiled_features(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """v, feat: embeddings rounded to 1/64, again and again up to the width, for models wider than the table's vectors."""
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 64) / 64)
    times = -(-width // WIDTH)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.slice(F.flatten(F.array_repeat(rounded, times)), 1, width).alias("feat"))


def weights(inputs: int, outputs: int) -> np.ndarray:
    i, o = np.indices((inputs, outputs))
    return ((i * 31 + o * 17) % 23 - 11) / 16.0


def small_weights(inputs: int, outputs: int) -> np.ndarray:
    i, o = np.indices((inputs, outputs))
    return ((i * 31 + o * 17) % 3 - 1) / 2.0


def recurrent(width: int) -> np.ndarray:
    i, o = np.indices((width, 4 * width))
    return ((i * 13 + o * 7) % 17 - 8) / 32.0


def attention(width: int) -> np.ndarray:
    """Columns for receivers and for sources."""
    k = np.arange(width)
    return np.stack([((k * 7) % 5 - 2) / 16.0, ((k * 3) % 7 - 3) / 16.0], 1)


def neighbour_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v, u: which suppliers a part has, for all parts. A row may repeat; operators on sets take it once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("u"))


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order(pos, v): vertex v moves to (7 v + 3) mod n, a bijection where 7 does not divide n."""
    n = size(spark, sf_dir)
    if n % 7 == 0:
        raise ValueError("7 divides the number of vertices")
    return vertices(spark, sf_dir).select(((F.col("v") * 7 + 3) % n).alias("pos"), "v")
