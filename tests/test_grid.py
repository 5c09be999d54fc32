"""Edge products on a grid against numpy, and what the grid shuffles."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import attention, edge_ops, grid


def graph(spark, n=60, m=900, width=5):
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, (n, width)).astype(float)
    ends = rng.integers(0, n + 3, (m, 2)).tolist()  # some ends have no vector
    edges = spark.createDataFrame([(i, d, s, f"e{i}", None) for i, (d, s) in enumerate(ends)] + [(-1, None, 1, "x", 1), (-2, 1, None, "y", 1)], "eid long, dst long, src long, s string, feat int").repartition(4)
    return ends, x, edges, spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "v long, feat array<double>")


@pytest.mark.parametrize("side", [1, 2, 5, None])
def test_products(spark, side):
    ends, x, edges, features = graph(spark)
    got = grid.inner_products(edges, features, features, 5, "product", side)
    assert got.columns == [*edges.columns, "product"]
    want = {i: (f"e{i}", float(x[d] @ x[s])) for i, (d, s) in enumerate(ends) if max(d, s) < len(x)}
    assert {r.eid: (r.s, r["product"]) for r in got.collect()} == want
    assert grid.inner_products(edges.where("eid > 9999"), features, features, 5).count() == 0
    assert grid.inner_products(edges, features.where("v < 0"), features, 5).count() == 0


def test_the_shuffle_carries_vertices_not_edges_times_width(spark):
    """Rows with vectors in the shuffle: vertices x side, of either end, and none per edge."""
    _, _, edges, features = graph(spark, 50, 4000)
    plan = grid.inner_products(edges.drop("s", "feat"), features, features, 5, side=3)
    assert plan.count() > 3000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join", text)
    both = features.crossJoin(spark.range(3)).count()
    assert both == 150 and grid.side_of(10**9, 64, 100) ** 2 < 10**9 and grid.side_of(100, 64, 16) == 4 and grid.side_of(100, 64, 1) == 1


def test_sddmm_is_the_same_by_hubs_by_broadcast_and_on_a_grid(spark, monkeypatch):
    _, _, edges, features = graph(spark)
    edges = edges.select("eid", "dst", "src").where("dst IS NOT NULL AND src IS NOT NULL")
    rows = lambda df: sorted((r.eid, r.s) for r in df.select("eid", F.col("s")).collect())
    want = rows(edge_ops.sddmm(edges, features, features, 5))
    assert want == rows(edge_ops.sddmm_grouped(edges, features, features, 5, share=4))
    monkeypatch.setattr(edge_ops, "MOST_BROADCAST", 0)
    assert rows(edge_ops.sddmm(edges, features, features, 5)) == want


def test_sums_on_a_grid(spark, monkeypatch):
    """A cell passes on a row for each of its receivers, whatever their edges."""
    ends, x, edges, features = graph(spark)
    want = np.zeros_like(x)
    for d, s in ends:
        if max(d, s) < len(x):
            want[d] += np.maximum(x[d] + x[s], 0)
    for side in (1, 3):
        groups = grid.relu_sums(edges, features, features, 5, side).collect()
        got = np.zeros_like(x)
        for r in groups:
            got[r.dst] += r.feat
        assert (got == want).all() and len(groups) <= side * len(x)
    monkeypatch.setattr(edge_ops, "MOST_BROADCAST", 0)
    for mlp in (edge_ops.edge_mlp, edge_ops.edge_mlp_grouped):
        y = {r.v: r.feat for r in mlp(edges, features, np.eye(5), features.select("v")).collect()}
        assert all(y[v] == want[v].tolist() for v in range(len(x)))
    text = edge_ops.sddmm_grouped(edges.select("eid", "dst", "src"), features, features, 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join", text)


def test_gradients_of_scores_shuffle_no_vectors_with_edges(spark):
    _, _, edges, features = graph(spark)
    edges = edges.select("dst", "src").where("dst IS NOT NULL AND src IS NOT NULL").withColumn("val", F.lit(1.0)).distinct()
    attn = attention.attention_pair(features, [0.1] * 5, [0.2] * 5)
    _, scores = attention.gat_backward(edges, features, attn, features, 5)
    assert "feat" not in scores._jdf.queryExecution().executedPlan().toString()
