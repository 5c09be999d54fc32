"""Edge scores, softmax by receiving vertex, and attention-weighted neighbour sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot, guarded_divide, leaky_relu, vector
from ..sources.scratch import written
from .aggregate import WIDE, gather, spmm, sum_vectors, zero_fill
from .grid import inner_products
from .hubs import SHARE, hubs, salted, spread


def attention_pair(features: DataFrame, to: list[float], of: list[float]) -> DataFrame:
    """attn(v, a_dst, a_src): each vertex's score as receiver and as source."""
    return features.select("v", dot(F.col("feat"), vector(to), len(to)).alias("a_dst"), dot(F.col("feat"), vector(of), len(of)).alias("a_src"))


def edge_scores(edges: DataFrame, attn: DataFrame, out: str = "z") -> DataFrame:
    """z = a_dst[dst] + a_src[src] on each edge."""
    to = attn.select(F.col("v").alias("dst"), "a_dst")
    of = attn.select(F.col("v").alias("src"), "a_src")
    return edges.join(of, "src").join(to, "dst").withColumn(out, F.col("a_dst") + F.col("a_src")).drop("a_dst", "a_src")


def edge_sums(edges: DataFrame, value: str, out: str = "s") -> DataFrame:
    """v, s: the sum of an edge value by receiving vertex."""
    return edges.groupBy("dst").agg(F.sum(value).alias(out)).withColumnRenamed("dst", "v")


def divide_by_dst(edges: DataFrame, sums: DataFrame, value: str = "z", total: str = "s", out: str = "p") -> DataFrame:
    """Each edge value over its receiver's sum."""
    return edges.join(sums.select(F.col("v").alias("dst"), F.col(total).alias("__total")), "dst").withColumn(out, F.col(value) / F.col("__total")).drop("__total")


def edge_softmax(edges: DataFrame, attn: DataFrame, slope: float = 0.2, stable: bool = False) -> DataFrame:
    """Adds p = exp(leaky(z)) / its sum over the receiver's edges; `stable` subtracts the receiver's greatest score first.

    The sums are partial aggregates joined back, so a vertex of high degree is not sorted in one task.
    """
    scored = edge_scores(edges, attn).withColumn("z", leaky_relu(F.col("z"), slope))
    if stable:
        top = scored.groupBy("dst").agg(F.max("z").alias("__top"))
        scored = scored.join(top, "dst").withColumn("z", F.col("z") - F.col("__top")).drop("__top")
    scored = scored.withColumn("z", F.exp("z"))
    return divide_by_dst(scored, edge_sums(scored, "z")).drop("z")


def gat_aggregate(edges: DataFrame, features: DataFrame, attn: DataFrame, vertices: DataFrame, width: int, slope: float = 0.2) -> DataFrame:
    """Attention as a ratio of sums: sum of e * x and sum of e in one pass, divided at the end; 0 for isolated vertices."""
    scored = edge_scores(edges.select("dst", "src"), attn).select("dst", "src", F.exp(leaky_relu(F.col("z"), slope)).alias("__e"))
    return _ratio(gather(scored, features), vertices, width)


def _ratio(rows: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    if width <= WIDE:
        sums = rows.groupBy("dst").agg(F.sum("__e").alias("__e"), *[F.sum(F.col("__e") * F.get("feat", F.lit(k))).alias(f"__{k}") for k in range(width)])
        sums = sums.select(F.col("dst").alias("v"), F.array(*[guarded_divide(F.col(f"__{k}"), F.col("__e")) for k in range(width)]).alias("feat"))
    else:
        both = sum_vectors(rows, ["dst"], F.concat(F.array(F.lit(1.0)), "feat"), width + 1, scale=F.col("__e"))
        tail = F.slice("feat", 2, width)
        sums = both.select(F.col("dst").alias("v"), F.transform(tail, lambda x: guarded_divide(x, F.get("feat", F.lit(0)))).alias("feat"))
    return zero_fill(vertices, sums, width)


def gat_grouped(edges: DataFrame, features: DataFrame, attn: DataFrame, vertices: DataFrame, width: int, slope: float = 0.2, share: int = SHARE) -> DataFrame:
    """The same in groups of neighbours: numerators and denominators are summed per group of a hub, merged, then divided. Both
    ends of an edge are joined by salted keys (see `hubs`)."""
    edges = written(edges.select("dst", "src"), "edges")
    found = hubs(edges, share)
    to = spread(attn.select("v", "a_dst"), found, "dst")
    of = spread(features.join(attn.select("v", "a_src"), "v"), found, "src")
    rows = salted(edges, found).join(to, ["dst", "dst_salt"]).join(of, ["src", "src_salt"])
    rows = rows.withColumn("__e", F.exp(leaky_relu(F.col("a_dst") + F.col("a_src"), slope)))
    groups = sum_vectors(rows, ["dst", "dst_salt"], F.concat(F.array(F.lit(1.0)), "feat"), width + 1, scale=F.col("__e"))
    sums = sum_vectors(groups, ["dst"], F.col("feat"), width + 1)
    ratio = F.transform(F.slice("feat", 2, width), lambda x: guarded_divide(x, F.get("feat", F.lit(0))))
    return zero_fill(vertices, sums.select(F.col("dst").alias("v"), ratio.alias("feat")), width)


def gat_composed(edges: DataFrame, features: DataFrame, attn: DataFrame, vertices: DataFrame, width: int, slope: float = 0.2) -> DataFrame:
    """The same step by step: scores, softmax, then a weighted neighbour sum."""
    p = edge_softmax(edges.drop("val"), attn, slope).withColumnRenamed("p", "val")
    return spmm(p, features, vertices, width)


def gat_linear(edges: DataFrame, features: DataFrame, attn: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """Attention without exponential: z over the sum of z, then a weighted neighbour sum."""
    scored = edge_scores(edges.drop("val"), attn)
    p = divide_by_dst(scored, edge_sums(scored, "z"), out="val").drop("z")
    return spmm(p, features, vertices, width)


def scale_rows(features: DataFrame, scale: DataFrame) -> DataFrame:
    """Each vector over its vertex's s, where that is not 0; scale(v, s)."""
    return features.join(scale, "v").select("v", F.transform("feat", lambda x: guarded_divide(x, F.col("s"))).alias("feat"))


def gat_backward(edges: DataFrame, features: DataFrame, attn: DataFrame, grad: DataFrame, width: int, slope: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Gradients of attention for an output gradient: (d features (v, feat), d attention (v, d_dst, d_src)).

    d x[src] sums p * dout[dst]. The score's gradient is p * (<x[src], dout[dst]> - its p-weighted mean by dst), times
    the leaky slope where the score is negative; it goes to both ends of the edge.
    """
    scored = edge_scores(edges.select("dst", "src"), attn)
    weighed = scored.withColumn("e", F.exp(leaky_relu(F.col("z"), slope)))
    p = divide_by_dst(weighed, edge_sums(weighed, "e"), "e").select("dst", "src", "p")
    there = p.join(grad.select(F.col("v").alias("dst"), F.col("feat").alias("dout")), "dst")
    d_feat = sum_vectors(there, ["src"], F.col("dout"), width, scale=F.col("p")).withColumnRenamed("src", "v")
    return d_feat, _score_gradients(scored, features, grad, width, slope)


def _score_gradients(scored: DataFrame, features: DataFrame, grad: DataFrame, width: int, slope: float) -> DataFrame:
    """v, d_dst, d_src from edges(dst, src, z). Products of both ends are taken on a grid (see `grid`), so edges are shuffled
    with numbers and never with vectors; a receiver's sums give its own gradient and the mean that its edges need."""
    rows = written(inner_products(scored.select("dst", "src", "z"), features, grad, width, "g"), "products")
    rows = rows.withColumn("e", F.exp(leaky_relu(F.col("z"), slope))).withColumn("k", F.when(F.col("z") < 0, F.lit(slope)).otherwise(F.lit(1.0)))
    e, g, k = F.col("e"), F.col("g"), F.col("k")
    sums = rows.groupBy("dst").agg(F.sum(e).alias("total"), F.sum(e * g).alias("eg"), F.sum(e * g * k).alias("egk"), F.sum(e * k).alias("ek"))
    sums = written(sums.withColumn("mean", F.col("eg") / F.col("total")), "sums")
    to = sums.select(F.col("dst").alias("v"), ((F.col("egk") - F.col("mean") * F.col("ek")) / F.col("total")).alias("d_dst"))
    dz = e / F.col("total") * (g - F.col("mean")) * k
    of = rows.join(sums.select("dst", "total", "mean"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum(dz).alias("d_src"))
    return to.join(of, "v", "full").select("v", F.coalesce("d_dst", F.lit(0.0)).alias("d_dst"), F.coalesce("d_src", F.lit(0.0)).alias("d_src"))
