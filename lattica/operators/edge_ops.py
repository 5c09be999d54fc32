"""Per-edge products: sampled dense-dense products and the edge MLP."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot, relu
from ..sources.scratch import written
from .aggregate import sum_vectors, zero_fill
from .dense import matmul
from .grid import inner_products, relu_sums, side_of
from .hubs import SHARE


#: Bytes of vectors up to which a table of them is broadcast.
MOST_BROADCAST = 8_000_000


def both_ends(edges: DataFrame, of: DataFrame, to: DataFrame) -> DataFrame:
    """Edges with x (the source's vector) and y (the receiver's)."""
    x = of.select(F.col("v").alias("src"), F.col("feat").alias("x"))
    y = to.select(F.col("v").alias("dst"), F.col("feat").alias("y"))
    return edges.join(x, "src").join(y, "dst")


def sddmm(edges: DataFrame, of: DataFrame, to: DataFrame, width: int) -> DataFrame:
    """s = <of[src], to[dst]> on each edge: by broadcast of both tables of vectors where they are counted to be small, in the
    cells of a grid beyond (see `grid`)."""
    if max(of.count(), to.count()) * width * 8 > MOST_BROADCAST:
        return inner_products(edges, of, to, width)
    rows = both_ends(edges, F.broadcast(of), F.broadcast(to))
    return rows.withColumn("s", dot(F.col("x"), F.col("y"), width)).drop("x", "y")


def _side(vertices: int, width: int, share: int) -> int:
    """Blocks on a side of a grid of `share` cells at least: a hub's edges are dealt over so many cells."""
    return max(side_of(vertices, width, 1), math.isqrt(max(1, share - 1)) + 1)


def sddmm_grouped(edges: DataFrame, of: DataFrame, to: DataFrame, width: int, share: int = SHARE) -> DataFrame:
    """The same on a grid of `share` cells or more, for tables of any size: a hub's edges are dealt over the cells of its row
    or column, in groups by the block of their other end, and its vector is sent to each of them once."""
    return inner_products(edges, of, to, width, side=_side(max(of.count(), to.count()), width, share))


def edge_mlp_grouped(edges: DataFrame, features: DataFrame, weights: np.ndarray, vertices: DataFrame, share: int = SHARE) -> DataFrame:
    """edge_mlp in groups of neighbours: a receiver's edges are summed by the cells of the grid that they fall into, then
    groups are merged."""
    width = np.asarray(weights).shape[1]
    h = written(matmul(features, weights), "layer")
    groups = relu_sums(edges, h, h, width, _side(h.count(), width, share))
    return zero_fill(vertices, sum_vectors(groups, ["dst"], F.col("feat"), width).withColumnRenamed("dst", "v"), width)


def edge_mlp(edges: DataFrame, features: DataFrame, weights: np.ndarray, vertices: DataFrame) -> DataFrame:
    """y[v] = sum over edges of relu((x[dst] + x[src]) W).

    The product is linear, so every vertex is multiplied once and edges only add: by broadcast of the products where they
    are counted to be small, in the cells of a grid beyond.
    """
    width = np.asarray(weights).shape[1]
    h = written(matmul(features, weights), "layer")
    if h.count() * width * 8 > MOST_BROADCAST:
        sums = sum_vectors(relu_sums(edges, h, h, width), ["dst"], F.col("feat"), width)
    else:
        rows = both_ends(edges, F.broadcast(h), F.broadcast(h))
        sums = sum_vectors(rows, ["dst"], F.zip_with("x", "y", lambda a, b: relu(a + b)), width)
    return zero_fill(vertices, sums.withColumnRenamed("dst", "v"), width)
