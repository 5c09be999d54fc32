"""Neighbour sums: sparse matrix times dense matrix as join and partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .hubs import SHARE, hubs, salted, spread

#: Widest feature vectors summed as one aggregation row; longer ones are cut into blocks of BLOCK features.
WIDE, BLOCK = 96, 64


def to_long(features: DataFrame) -> DataFrame:
    """features(v, feat) -> (v, k, x)."""
    return features.select("v", F.posexplode("feat").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


def to_wide(long: DataFrame) -> DataFrame:
    """(v, k, x) -> features(v, feat), by ascending k."""
    ordered = long.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kx"))
    return ordered.select("v", F.transform("kx", lambda s: s["x"]).alias("feat"))


def sum_vectors(rows: DataFrame, keys: list[str], column: Column, width: int, out: str = "feat", scale: Column | None = None) -> DataFrame:
    """Sums a vector column, times a scalar one if given, by keys; map-side partial sums leave one row a key and task to
    shuffle. A vector wider than WIDE is a row per block of features, each summed as one wide row, and put together again
    after the sum."""
    held = rows.select(*keys, column.alias("__v"), (F.lit(None) if scale is None else scale).alias("__s"))
    if width <= WIDE:
        sums = _sum_rows(held, keys, width, scale is not None)
        return sums.select(*keys, F.col("__sums").alias(out))
    blocks = F.array(*[F.slice("__v", at + 1, BLOCK) for at in range(0, width, BLOCK)])
    cut = held.select(*keys, "__s", F.posexplode(blocks).alias("__block", "__v"))
    sums = _sum_rows(cut, [*keys, "__block"], BLOCK, scale is not None)
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "__sums"))).alias("__blocks"))
    return whole.select(*keys, F.slice(F.flatten(F.transform("__blocks", lambda b: b["__sums"])), 1, width).alias(out))


def _sum_rows(held: DataFrame, keys: list[str], width: int, scaled: bool) -> DataFrame:
    """keys, __sums: sums of the vectors __v of one width, times __s if scaled, as a single row of sums."""
    term = lambda k: F.col("__s") * F.get("__v", F.lit(k)) if scaled else F.get("__v", F.lit(k))
    sums = held.groupBy(*keys).agg(*[F.sum(term(k)).alias(f"__{k}") for k in range(width)])
    return sums.select(*keys, F.array(*[F.col(f"__{k}") for k in range(width)]).alias("__sums"))


def zero_fill(vertices: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """Every vertex with its vector; zeros for those that received nothing."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return vertices.select("v").join(sums.select("v", "feat"), "v", "left").select("v", F.coalesce("feat", zeros).alias("feat"))


def gather(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Each edge with its source's vector."""
    return edges.join(features.withColumnRenamed("v", "src"), "src")


def gather_steps(edges: DataFrame, features: DataFrame) -> DataFrame:
    """dst, step, feat: neighbours' vectors by place in the row."""
    from .order import position_in_row

    return gather(position_in_row(edges), features).select("dst", "step", "feat")


def spmm(edges: DataFrame, features: DataFrame, vertices: DataFrame, width: int, weighted: bool = True) -> DataFrame:
    """y[v] = sum of val * x[src] over the edges into v; 0 for a vertex without edges."""
    sums = sum_vectors(gather(edges, features), ["dst"], F.col("feat"), width, scale=F.col("val") if weighted else None)
    return zero_fill(vertices, sums.withColumnRenamed("dst", "v"), width)


def spmm_grouped(edges: DataFrame, features: DataFrame, vertices: DataFrame, width: int, parts: int = 1, share: int = SHARE, weighted: bool = True) -> DataFrame:
    """The same in groups of neighbours: hubs are found, their edges are gathered and summed per group, groups are merged.

    A vertex that sends or receives 1 / share or more of the edges has several keys (see `hubs`), so no task of the gather
    or of the sums gets more than about that, whatever the degrees. With `parts`, groups also end at the borders of so many
    ranges of source ids, and a group's sum reads one range of features.
    """
    edges = written(edges, "edges")
    found = hubs(edges, share)
    rows = salted(edges, found)
    if parts > 1:
        least, most = edges.agg(F.min("src"), F.max("src")).head()
        step = max(1, -(-((most or 0) - (least or 0) + 1) // parts))
        rows = rows.withColumn("__range", F.floor((F.col("src") - F.lit(least or 0)) / step))
    gathered = rows.join(spread(features, found, "src"), ["src", "src_salt"])
    groups = sum_vectors(gathered, ["dst", "dst_salt", *["__range"] * (parts > 1)], F.col("feat"), width, scale=F.col("val") if weighted else None)
    return zero_fill(vertices, sum_vectors(groups, ["dst"], F.col("feat"), width).withColumnRenamed("dst", "v"), width)


def spmm_ranges(edges: DataFrame, features: DataFrame, vertices: DataFrame, width: int, lower: int, upper: int) -> DataFrame:
    """Only sources in [lower, upper): one pass of a range-by-range sum."""
    return spmm(edges.where((F.col("src") >= lower) & (F.col("src") < upper)), features, vertices, width)


def scatter_sum(values: DataFrame, index: str, value: str, out: str = "total") -> DataFrame:
    """Sum of a value by index."""
    return values.groupBy(index).agg(F.sum(value).alias(out))


def degrees(edges: DataFrame, vertices: DataFrame, limit: int | None = None) -> DataFrame:
    """v, deg: edges into each vertex, at most `limit` if one is given."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("deg")).withColumnRenamed("dst", "v")
    deg = F.coalesce("deg", F.lit(0)).cast("long")
    return vertices.select("v").join(counts, "v", "left").select("v", (F.least(deg, F.lit(limit).cast("long")) if limit is not None else deg).alias("deg"))


def update_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Replaces val by that of values(eid, val); edges without a new value keep theirs."""
    fresh = values.select("eid", F.col("val").alias("__val"))
    return edges.join(fresh, "eid", "left").withColumn("val", F.coalesce("__val", "val")).drop("__val")
