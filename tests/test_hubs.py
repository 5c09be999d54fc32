"""Hubs: the sketch against true counts, and star graphs whose tasks stay even without Spark's own handling of skew."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import aggregate, attention, edge_ops, hubs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 12), st.integers(1, 40))
def test_sketch(values, most, step):
    held: dict = {}
    for at in range(0, len(values), step):
        held = hubs.sketched(held, np.array(values[at : at + step]), most)
    assert len(held) <= most
    for v in set(values):
        n = values.count(v)
        assert n - len(values) / most <= held.get(v, 0) <= n


@pytest.fixture
def uneven(spark):
    """Joins and sums are shuffled, and Spark neither splits nor merges partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def star(spark, inwards, n=6000):
    """Vertex 0 has nine tenths of the edges, all others form a ring."""
    ring = spark.range(n).select(F.col("id").alias("dst"), ((F.col("id") + 1) % n).alias("src"))
    ring = ring.where("dst % 9 = 1")
    rays = spark.range(1, n).select(F.lit(0).cast("long").alias("dst"), F.col("id").alias("src"))
    rays = rays if inwards else rays.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    edges = ring.unionByName(rays).distinct().withColumn("val", F.lit(1.0))
    x = spark.range(n).select(F.col("id").alias("v"), F.array((F.col("id") % 13).cast("double"), F.lit(1.0)).alias("feat"))
    return edges, x


def by_task(rows):
    return sorted(r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("inwards", [True, False])
def test_star(spark, uneven, inwards):
    edges, x = star(spark, inwards)
    found = hubs.hubs(edges)
    assert {(r.side, r.v) for r in found.collect()} == {("dst" if inwards else "src", 0)}
    plain = by_task(aggregate.gather(edges, x))
    both = hubs.salted(edges, found)
    gathered = both.join(hubs.spread(x, found, "src"), ["src", "src_salt"])
    summed = both.repartition(8, "dst", "dst_salt")  # as the sums deal rows out, were nothing summed before
    for sizes in (by_task(gathered), by_task(summed)):
        assert sum(sizes) == edges.count() and len(sizes) == 8 and sizes[-1] <= 2 * np.median(sizes)
    assert inwards or plain[-1] > 4 * np.median(plain)
    v = x.select("v")
    rows = lambda df, c="feat": sorted((r.v, *np.round(r[c], 9)) for r in df.collect())
    want = rows(aggregate.spmm(edges, x, v, 2))
    assert rows(aggregate.spmm_grouped(edges, x, v, 2)) == want == rows(aggregate.spmm_grouped(edges, x, v, 2, parts=3))
    attn = attention.attention_pair(x, [0.1, -0.2], [0.05, 0.1])
    assert rows(attention.gat_grouped(edges, x, attn, v, 2)) == rows(attention.gat_aggregate(edges, x, attn, v, 2))
    w = np.array([[1.0, -1.0], [0.5, 2.0]])
    assert rows(edge_ops.edge_mlp_grouped(edges, x, w, v)) == rows(edge_ops.edge_mlp(edges, x, w, v))
    pair = lambda df: sorted((r.dst, r.src, r.s) for r in df.collect())
    assert pair(edge_ops.sddmm_grouped(edges, x, x, 2)) == pair(edge_ops.sddmm(edges, x, x, 2))


def test_hubs_at_both_ends_nulls_and_empty(spark):
    rows = [(0, i, 1.0) for i in range(300)] + [(i, 0, 1.0) for i in range(1, 300)] + [(None, 3, 1.0), (3, None, 1.0)] * 2
    edges = spark.createDataFrame(rows, "dst long, src long, val double").repartition(7)
    found = {(r.side, r.v): r.copies for r in hubs.hubs(edges, 16).collect()}
    assert set(found) == {("dst", 0), ("src", 0)} and all(7 <= c <= 11 for c in found.values())
    assert hubs.hubs(edges.where("val > 5")).count() == 0
    x = spark.createDataFrame([(i, [float(i)]) for i in range(300)], "v long, feat array<double>")
    got = {r.v: r.feat[0] for r in aggregate.spmm_grouped(edges, x, x.select("v"), 1, share=16).collect()}
    assert got[0] == sum(range(300)) and all(got[i] == 0.0 for i in range(1, 300))
