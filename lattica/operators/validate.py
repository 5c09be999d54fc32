"""Comparing two results, directly or under a permutation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import to_long


def mismatches(result: DataFrame, truth: DataFrame, relative: float = 1e-2, absolute: float = 0.0) -> DataFrame:
    """n, wrong: elements compared, and those off by more than relative * |truth| + absolute."""
    r, t = to_long(result).withColumnRenamed("x", "r"), to_long(truth).withColumnRenamed("x", "t")
    bad = F.abs(F.col("r") - F.col("t")) > F.abs("t") * relative + absolute
    return r.join(t, ["v", "k"], "full").agg(F.count("*").alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("wrong"))


def mismatches_reordered(result: DataFrame, truth: DataFrame, order: DataFrame, absolute: float = 1e-2) -> DataFrame:
    """The same where row pos of the result stands for vertex v of order(pos, v)."""
    back = result.withColumnRenamed("v", "pos").join(order, "pos").select("v", "feat")
    return mismatches(back, truth, 0.0, absolute)
