"""Vertices with a large share of all edges: found by a bounded sketch, and spread over several keys in joins and sums.

A shuffle sends all edges of a vertex to one task. A hub, a vertex with 1 / SHARE or more of the edges at one of its ends,
is given copies: its edges are dealt over (vertex, salt), and what they are joined with is copied to each salt. All other
vertices keep salt 0, so nothing else moves twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: A key of a salted join or sum holds about 1 / SHARE of the edges at most.
SHARE = 256
#: Entries of a sketch for each share: with so many, a hub's count is known to a quarter.
SLACK = 4


def sketched(held: dict[int, int], values: np.ndarray, most: int) -> dict[int, int]:
    """A sketch of a stream's frequent values with more of the stream: at most `most` counts. Each is at most the truth, and
    at most n / most below it after n values, so a value that comes more often than that is held."""
    for v, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True):
        held[v] = held.get(v, 0) + n
    if len(held) <= most:
        return held
    cut = sorted(held.values(), reverse=True)[most]
    return {v: n - cut for v, n in held.items() if n > cut}


def hubs(edges: DataFrame, share: int = SHARE) -> DataFrame:
    """side ("src" or "dst"), v, copies (2 or more): the hubs among the ends of edges(dst, src), at most 2 x SLACK x share rows.

    Tasks sketch their edges and the sketches are added up: counts stay within a bounded part of the truth, so what is
    kept is bounded whatever the number of vertices. An end that is null is no hub.
    """
    most = SLACK * share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = {"dst": {}, "src": {}}, 0
        for batch in batches:
            total += batch.num_rows
            for side in kept:
                kept[side] = sketched(kept[side], batch.column(side).drop_null().to_numpy(), most)
        for side, held in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(held), pa.string()), pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["side", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["side", "v", "n"])

    counts = written(edges.select(F.col("dst").cast("long"), F.col("src").cast("long")).mapInArrow(run, "side string, v long, n long").groupBy("side", "v").agg(F.sum("n").alias("n")), "sketch")
    row = counts.where("side = 'all'").agg(F.sum("n")).head()
    total = row[0] or 0
    copies = F.ceil(F.col("n") * share / max(1, total)).cast("int") + 1  # the count may be a quarter of a share too low
    return counts.where((F.col("side") != "all") & (F.col("n") * share * 4 >= 3 * total) & (F.lit(total) >= share)).select("side", "v", copies.alias("copies"))


def salted(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Adds src_salt and dst_salt: 0, or for an edge of a hub one of its copies by a hash of the other end."""
    for side, other in (("src", "dst"), ("dst", "src")):
        mine = found.where(F.col("side") == side).select(F.col("v").alias(side), F.col("copies").alias("__copies"))
        salt = F.coalesce(F.pmod(F.xxhash64(other), F.col("__copies")), F.lit(0)).cast("int")
        edges = edges.join(F.broadcast(mine), side, "left").withColumn(f"{side}_salt", salt).drop("__copies")
    return edges


def spread(table: DataFrame, found: DataFrame, side: str, v: str = "v") -> DataFrame:
    """A table of vertices with a row per copy, its key named `side` and its copy `side`_salt: what salted edges join."""
    mine = found.where(F.col("side") == side).select(F.col("v").alias(v), F.col("copies").alias("__copies"))
    rows = table.join(F.broadcast(mine), v, "left")
    every = F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)
    return rows.withColumn(f"{side}_salt", F.explode(every)).drop("__copies").withColumnRenamed(v, side)
