"""Queries see the whole input: every part and every component."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import fixtures as fx
from lattica import queries
from lattica.operators import lstm, reorder


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with a lineitem of parts on both sides of 300, and the suppliers of each part."""
    rng, folder = random.Random(7), tmp_path_factory.mktemp("parts")
    rows = [(p, rng.randrange(9)) for p in [3, 299, 300, *range(1000, 1040)] for _ in range(5)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder), {p: {u for q, u in rows if q == p} for p, _ in rows}


def brute(sets):
    shared = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2)}
    return {k: (n, n / m) for k, (n, m) in shared.items() if n}


def test_pairs_of_all_parts(spark, parts, monkeypatch):
    d, sets = parts
    monkeypatch.setattr(reorder, "BLOCK", 8)
    want = brute(sets)
    got = queries.queries()["jaccard_pairs"](spark, d).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.common, r.jaccard) for r in got} == {k: (n, round(j, 9)) for k, (n, j) in want.items()}
    best = [(r.a, r.b) for r in queries.queries()["pair_queue"](spark, d).collect()]
    assert best == sorted(want, key=lambda k: (-want[k][1], k))[:100]
    similar = reorder.jaccard_pairs(spark.createDataFrame([(v, u) for v, s in sets.items() for u in s], "v long, u long"), 0.2)
    assert {(r.a, r.b) for r in similar.collect()} == {k for k, (_, j) in want.items() if j >= 0.2}


def test_signatures_candidates_and_clusters_of_all_parts(spark, parts):
    d, sets = parts
    named = queries.queries()
    assert {r.v for r in named["minhash_signature"](spark, d).collect()} == set(sets)
    assert sorted(r.v for r in named["cluster_order"](spark, d).collect()) == sorted(sets)
    want = brute(sets)
    got = {(r.a, r.b): r.jaccard for r in named["lsh_candidates"](spark, d).collect()}
    assert all(round(want.get(k, (0, 0.0))[1], 9) == j for k, j in got.items())
    assert {k for k, (_, j) in want.items() if j == 1} <= set(got) and any(a > 300 for a, _ in got)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """A folder with 23 vertices of 64 components and 600 rows of edges, and the edges and vectors in numpy."""
    rng, folder, n = np.random.default_rng(3), tmp_path_factory.mktemp("graph"), 23
    x = np.round(rng.normal(size=(n, 64)) * 1024) / 1024
    spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    rows = rng.integers(0, 1000, (600, 3)).tolist()
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    pairs = [(p % n - (p % n % fx.GAP == 3), (o * 7 + s) % n) for o, p, s in rows]
    edges = [(d, s, pairs.count((d, s))) for d, s in sorted(set(pairs))]
    return str(folder), edges, x.astype(np.float32).astype(float)


def cells(spark, graph, name, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in queries.queries()[name](spark, graph[0]).collect()}


def test_gathers_of_whole_vectors(spark, graph):
    _, edges, x = graph
    at = {d: [s for e, s, _ in edges if e == d] for d, _, _ in edges}
    assert cells(spark, graph, "gather", ("eid", "k"), "x") == {(i, k): x[s, k] for i, (_, s, _) in enumerate(edges) for k in range(64)}
    assert cells(spark, graph, "edge_message", ("eid", "k"), "m") == {(i, k): w * x[s, k] for i, (_, s, w) in enumerate(edges) for k in range(64)}
    assert cells(spark, graph, "gather_steps", ("dst", "step", "k"), "x") == {(d, i, k): x[s, k] for d, row in at.items() for i, s in enumerate(row) for k in range(64)}


def test_products_and_lstm_of_whole_vectors(spark, graph):
    _, edges, x = graph
    y = x @ fx.weights(64, 8)
    assert cells(spark, graph, "dense_matmul_long", ("v", "o"), "y") == pytest.approx({(v, o): y[v, o] for v in range(len(x)) for o in range(8)})
    want = {}
    for d in {e for e, _, _ in edges}:
        row = [s for e, s, _ in edges if e == d][: fx.NEIGHBOURS]
        h = c = np.zeros((1, 64))
        for s in row:
            h, c = lstm.step(x[[s]] @ fx.weights(64, 256) + h @ fx.recurrent(64), c)
        want |= {(d, k): h[0, k] for k in range(64) if len(row) == fx.NEIGHBOURS}
    assert want
    for name in ("sage_lstm_base", "sage_lstm_bypass"):
        assert cells(spark, graph, name, ("v", "k"), "y") == pytest.approx(want, abs=2e-6)


def test_gradients_of_whole_vectors(spark, graph):
    _, edges, x = graph
    a = x @ fx.attention(64)
    d_x, d_dst, d_src = np.zeros_like(x), np.zeros(len(x)), np.zeros(len(x))
    for d in {e for e, _, _ in edges}:
        row = [s for e, s, _ in edges if e == d]
        z = a[d, 0] + a[row, 1]
        p = np.exp(np.maximum(z, 0.2 * z))
        p /= p.sum()
        g = x[row] @ x[d]
        dz = p * (g - p @ g) * np.where(z < 0, 0.2, 1)
        d_x[row] += p[:, None] * x[d]
        d_dst[d] += dz.sum()
        d_src[row] += dz
    got = cells(spark, graph, "gat_backward", ("v", "k"), "d_x")
    assert len(got) == 64 * len({s for _, s, _ in edges}) and all(got[v, k] == pytest.approx(d_x[v, k], abs=2e-6) for v, k in got)
    scores = cells(spark, graph, "gat_backward_scores", ("v",), "d_dst"), cells(spark, graph, "gat_backward_scores", ("v",), "d_src")
    for found, want in zip(scores, (d_dst, d_src), strict=True):
        assert {v for (v,) in found} == {v for e in edges for v in e[:2]} and all(found[v,] == pytest.approx(want[v], abs=2e-6) for (v,) in found)


def test_only_blocks_that_share_a_member_meet(spark, monkeypatch):
    """Copies with members of their own cost their own cells, and a common member a bounded number of ranges of blocks."""
    monkeypatch.setattr(reorder, "BLOCK", 4)
    rows = [(v + 1000 * (v % 6), 50 * (v % 6) + (v * i) % 7) for v in range(48) for i in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "v long, u long")
    lists, cells = reorder.blocked(frame)
    assert lists.select("block").distinct().count() == 12 and cells.count() == 18  # two blocks a copy, three cells
    sets = {v: {u for w, u in rows if w == v} for v, _ in rows}
    want = brute(sets)
    assert {(r.a, r.b): r.common for r in reorder.jaccard_pairs(frame).collect()} == {k: n for k, (n, _) in want.items()}
    monkeypatch.setattr(reorder, "MEETINGS", 4)
    shared = frame.unionByName(frame.select("v", F.lit(-1).cast("long").alias("u")).distinct())
    assert reorder.blocked(shared)[1].count() == 78
    both = brute({v: s | {-1} for v, s in sets.items()})
    assert {(r.a, r.b): r.common for r in reorder.jaccard_pairs(shared).collect()} == {k: n for k, (n, _) in both.items()}
    best = reorder.jaccard_pairs(shared, top=5).orderBy(F.desc("jaccard"), "a", "b").limit(5).collect()
    assert [(r.a, r.b) for r in best] == sorted(both, key=lambda k: (-both[k][1], k))[:5]
