"""Connected components: few links by union-find in one executor task, more by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links (some 200 bytes each as Python numbers) that one task may hold.
ONE_TASK = 300_000


class Groups:
    """Union-find; a group's root is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        up = self.up
        while (w := up.setdefault(v, v)) != v:
            up[v] = up[w]
            v = w
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = Groups()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            groups.join(u, v)
    known = list(groups.up)
    yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array([groups.root(v) for v in known], pa.int64())], ["v", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """v, component: each vertex of edges (a, b) with the smallest vertex that it reaches. Loops and nulls are dropped."""
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    seen = mark(now)
    if seen[0] <= one_task:
        return materialise(now.repartition(1).mapInArrow(_together, "v long, component long"), "components")
    while seen[0]:
        now = materialise(_small_star(_large_star(now)).distinct(), "stars")
        if (mark_now := mark(now)) == seen:
            break
        seen = mark_now
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(now.select(F.col("v"), F.col("v").alias("component"))).distinct()
