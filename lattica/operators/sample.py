"""Frontiers, induced subgraphs and neighbour sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .order import compacted


#: Parts that a vertex's edges are dealt over before they are cut.
PARTS = 64
#: Edges of a task that cuts them, by their count, so that what a task sorts doesn't grow with the table.
TASK_ROWS = 250_000


def sample_key(dst: Column, src: Column, seed: int | Column = 0) -> Column:
    """A random key of 64 bits, in hexadecimal, for each edge and seed: a vertex takes the neighbours with the least. It is a
    digest of the decimal numbers, so any engine can repeat it."""
    words = [x.cast("string") for x in (F.lit(seed), dst, src)]
    return F.substring(F.md5(F.encode(F.concat_ws(":", *words), "UTF-8")), 1, 16)


def frontier(active: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """layers - 1 expansions. Each hop follows only the vertices that the last one found, and is written, so that the plan
    grows by one small table a hop."""
    new = out = active.select("v").distinct()
    for _ in range(layers - 1):
        reached = edges.join(new.withColumnRenamed("v", "dst"), "dst", "left_semi").select(F.col("src").alias("v")).distinct()
        new = written(reached.join(out, "v", "left_anti"), "hop")
        out = out.unionByName(new)
    return out


def subgraph(active: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, v, begin, deg) and (row, dst, src, eid): active vertices with all their edges; sources keep their ids."""
    kept = edges.join(active.select(F.col("v").alias("dst")), "dst", "left_semi")
    counts = kept.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("deg"))
    rows = compacted(active, counts)
    return rows, kept.join(rows.select("row", F.col("v").alias("dst")), "dst").select("row", "dst", "src", "eid")


def chosen_neighbours(edges: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """min(deg, limit) distinct neighbours of each vertex, every set of that size as likely as any other.

    A vertex takes the neighbours with the least sample_key: bottom-k lists, which can be merged. Each vertex's edges are
    dealt over parts by a hash of the source and cut to `limit` there, then parts are merged, so neither a hub's edges nor
    its lists meet in one task before they are short.
    """
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_ROWS))
    dealt = edges.withColumn("__part", F.pmod(F.xxhash64("src"), F.lit(PARTS))).repartition(tasks, "dst", "__part")
    distinct = dealt.dropDuplicates(["dst", "src", "__part"]).withColumn("__key", sample_key(F.col("dst"), F.col("src"), seed))
    for by in (["dst", "__part"], ["dst"]):
        order = Window.partitionBy(*by).orderBy("__key", "src")
        distinct = distinct if len(by) > 1 else distinct.repartition(tasks, "dst")
        distinct = distinct.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return distinct.drop("__n", "__part", "__key")


def sampled_subgraph(active: DataFrame, edges: DataFrame, limit: int, layers: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The subgraph of a frontier that follows only chosen neighbours; each vertex keeps the same choice at every layer."""
    chosen = written(chosen_neighbours(edges, limit, seed), "chosen")
    return subgraph(frontier(active, chosen, layers), chosen)


def full_graph(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole graph as a subgraph: rows are the vertices."""
    return subgraph(vertices, edges)
