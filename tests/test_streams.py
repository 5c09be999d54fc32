"""What a load parses once, and what reaches Python a step at a time."""

from __future__ import annotations

import numpy as np
import pytest

from lattica import api
from lattica.operators import lstm
from lattica.sources import files


def test_the_first_cached_load_parses_the_text_once(spark, tmp_path, monkeypatch):
    seen, parse = spark.sparkContext.accumulator(0), files.read_csr_text

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(files, "read_csr_text", lambda *a: (lambda e: e.mapInArrow(counted, e.schema))(parse(*a)))
    (tmp_path / "g.config").write_text("3 4")
    (tmp_path / "g.graph").write_text("0 2 2 4\n1 2 0 1\n")
    edges, _ = api.load_graph(spark, f"{tmp_path}/g", "cached")
    assert [tuple(r) for r in edges.orderBy("eid").collect()] == [(0, 0, 1, 1.0), (1, 0, 2, 1.0), (2, 2, 0, 1.0), (3, 2, 1, 1.0)]
    assert seen.value == 4


@pytest.mark.parametrize("bypass", [True, False])
@pytest.mark.parametrize("batch", [1, 2, 3, 4, 100])
def test_lstm_steps_reach_python_as_rows_and_batches_may_cut_a_vertex(spark, bypass, batch):
    """No row holds a vertex's whole sequence, and the fold gives the same wherever a batch ends."""
    rng = np.random.default_rng(5)
    x, w, u = rng.normal(size=(40, 3)), rng.normal(size=(3, 8)), rng.normal(size=(2, 8))
    rows = [(v, int(rng.integers(40))) for v in range(40) for _ in range(v % 5 + 1)]
    edges = spark.createDataFrame([(e, v, s, 1.0) for e, (v, s) in enumerate(rows)], "eid long, dst long, src long, val double")
    features = spark.createDataFrame([(v, x[v].tolist()) for v in range(40)], "v long, feat array<double>")
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = lstm.sage_lstm(edges, features, w, u, 3, bypass)
        got = out.collect()
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    want = {}
    for v in range(40):
        near = [s for r, s in rows if r == v][:3]
        if len(near) == 3:
            h = c = np.zeros((1, 2))
            for s in near:
                h, c = lstm.step(x[[s]] @ w + h @ u, c)
            want[v] = h[0]
    assert sorted(r.v for r in got) == sorted(want) and len(want) == 24
    assert all(np.allclose(r.feat, want[r.v], rtol=1e-12, atol=1e-15) for r in got)


def test_lstm_deals_vertices_even_if_a_join_has_dealt_the_edges(spark, tmp_path):
    """Else the edges are read where they were written once that join becomes a broadcast, a vertex's steps in several tasks."""
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(e, e // 10, int(rng.integers(30)), 1.0) for e in range(320)], "eid long, dst long, src long, val double")
    edges.repartitionByRange(8, "eid").write.parquet(f"{tmp_path}/e")
    x = rng.normal(size=(30, 3))
    spark.createDataFrame([(v, x[v].tolist()) for v in range(30)], "v long, feat array<double>").coalesce(1).write.parquet(f"{tmp_path}/x")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # the features are below, the edges above
    try:
        out = lstm.sage_lstm(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/x"), rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), 8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == plan.count("BroadcastHashJoin") == plan.count("REPARTITION_BY_COL") == 1
        assert sorted(r.v for r in out.select("v").collect()) == list(range(32))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
