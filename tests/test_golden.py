"""A graph of four vertices worked out by hand; vertex 2 is isolated."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregate, attention, edge_ops, lstm, metrics, order, reorder, sample, schedule, validate
from lattica.operators.schedule import Schedule
from lattica.plans.rewrite import Linear
from lattica.sources import catalog, files

PTR, IDX, VAL = [0, 2, 3, 3, 5], [1, 2, 0, 0, 2], [1.0, 2.0, 3.0, 1.0, 0.5]
X = {0: [1.0, 2.0], 1: [3.0, -1.0], 2: [0.0, 4.0], 3: [5.0, 5.0]}


@pytest.fixture(scope="module")
def graph(spark):
    rows = []
    for dst in range(4):
        for at in range(PTR[dst], PTR[dst + 1]):
            rows.append((at, dst, IDX[at], VAL[at]))
    edges = spark.createDataFrame(rows, "eid long, dst long, src long, val double")
    features = spark.createDataFrame(list(X.items()), "v long, feat array<double>")
    return edges, features, features.select("v")


def feats(df):
    return {r.v: tuple(r.feat) for r in df.collect()}


def test_spmm(graph):
    edges, x, v = graph
    weighted = {0: (3, 7), 1: (3, 6), 2: (0, 0), 3: (1, 4)}
    assert feats(aggregate.spmm(edges, x, v, 2)) == weighted
    assert feats(aggregate.spmm(edges, x, v, 2, weighted=False)) == {0: (3, 3), 1: (1, 2), 2: (0, 0), 3: (1, 6)}
    for kind in Schedule:
        for group in (1, 2, 32):
            tasked = schedule.tasked(edges, kind, 4, 2, group)
            assert feats(aggregate.spmm_grouped(tasked.select('dst', 'src', 'val'), x, v, 2, share=2)) == weighted
            assert schedule.tasks(tasked).agg(F.sum("size")).head()[0] == 5


def test_wide_and_long_sums_agree(spark, graph):
    edges, _, v = graph
    x = v.select("v", F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: (F.col("v") + k).cast("double")).alias("feat"))
    got = feats(aggregate.spmm(edges, x, v, 120))
    assert got[0] == tuple(1 * (1 + k) + 2 * (2 + k) for k in range(120)) and got[2] == (0.0,) * 120
    assert feats(aggregate.to_wide(aggregate.to_long(x)))[3] == tuple(float(3 + k) for k in range(120))


def test_sddmm_mlp_dense(graph):
    edges, x, v = graph
    assert {r.eid: r.s for r in edge_ops.sddmm(edges, x, x, 2).collect()} == {0: 1, 1: 8, 2: 1, 3: 15, 4: 20}
    for mlp in (edge_ops.edge_mlp, edge_ops.edge_mlp_grouped):
        assert feats(mlp(edges, x, np.eye(2), v)) == {0: (5, 7), 1: (4, 1), 2: (0, 0), 3: (11, 16)}
    w = np.array([[1.0, -2.0, 0.5], [0.25, 3.0, 1.0]])
    assert feats(Linear(w, True).apply(edges, x, v, True)) == feats(Linear(w, True).apply(edges, x, v, False))
    assert Linear(np.ones((8, 2))).dense_first() and not Linear(np.ones((2, 8))).dense_first()


def test_attention(spark, graph):
    edges, x, v = graph
    attn = spark.createDataFrame([(i, 0.0, math.log(2) if i == 1 else 0.0) for i in range(4)], "v long, a_dst double, a_src double")
    for stable in (False, True):
        p = {r.eid: r.p for r in attention.edge_softmax(edges, attn, stable=stable).collect()}
        assert p == pytest.approx({0: 2 / 3, 1: 1 / 3, 2: 1, 3: 0.5, 4: 0.5})
    want = {0: (2, 2 / 3), 1: (1, 2), 2: (0, 0), 3: (0.5, 3)}
    for got in (attention.gat_aggregate(edges, x, attn, v, 2), attention.gat_composed(edges, x, attn, v, 2), attention.gat_grouped(edges, x, attn, v, 2, share=2)):
        assert {k: pytest.approx(y) for k, y in want.items()} == feats(got)
    s = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 1.0), (3, 5.0)], "v long, s double")
    assert feats(attention.scale_rows(x, s)) == {0: (0.5, 1), 1: (3, -1), 2: (0, 4), 3: (1, 1)}


def test_attention_backward(spark, graph):
    edges, x, v = graph
    rng = np.random.default_rng(0)
    base = rng.normal(size=(4, 2))
    out_grad = {i: rng.normal(size=2) for i in range(4)}

    def loss(feat, a):
        total = 0.0
        for dst in range(4):
            at = range(PTR[dst], PTR[dst + 1])
            if len(at):
                z = np.array([a[dst, 0] + a[IDX[e], 1] for e in at])
                e = np.exp(np.maximum(z, 0.2 * z))
                total += out_grad[dst] @ (e @ np.array([feat[IDX[e_]] for e_ in at]) / e.sum())
        return total

    feat = np.array([X[i] for i in range(4)])
    attn = spark.createDataFrame([(i, float(base[i, 0]), float(base[i, 1])) for i in range(4)], "v long, a_dst double, a_src double")
    grad = spark.createDataFrame([(i, [float(t) for t in g]) for i, g in out_grad.items()], "v long, feat array<double>")
    d_feat, d_attn = attention.gat_backward(edges, x, attn, grad, 2)
    got_f, got_a = feats(d_feat), {r.v: (r.d_dst, r.d_src) for r in d_attn.collect()}
    for i in range(4):
        for k in range(2):
            step = np.zeros((4, 2))
            step[i, k] = 1e-6
            assert got_f.get(i, (0, 0))[k] == pytest.approx((loss(feat + step, base) - loss(feat - step, base)) / 2e-6, abs=1e-6)
            assert got_a.get(i, (0, 0))[k] == pytest.approx((loss(feat, base + step) - loss(feat, base - step)) / 2e-6, abs=1e-6)


def test_schedules(graph):
    edges, _, _ = graph
    table = lambda kind, parts, group: [tuple(r) for r in schedule.tasks(schedule.tasked(edges, kind, 4, parts, group)).orderBy("task_id").select("ptr", "dst").collect()]
    assert table(Schedule.NEIGHBOR_GROUPING, 1, 1) == [(0, 0), (1, 0), (2, 1), (3, 3), (4, 3)]
    assert table(Schedule.NEIGHBOR_GROUPING, 1, 2) == [(0, 0), (2, 1), (3, 3)]
    rows = schedule.tasked(edges, Schedule.LOCALITY, 4, 2)
    assert [r.dst for r in schedule.tasks(rows).orderBy("task_id").collect()] == [0, 1, 3, 0, 3]
    assert [r.src for r in schedule.task_edges(rows).orderBy("pos").collect()] == [1, 0, 0, 2, 2]
    assert tuple(schedule.task_stats(schedule.tasks(rows), 2).head()) == (5, 5, 1, 1, 5, 0)


def test_reorder(spark, graph):
    edges, x, v = graph
    p = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "pos long, v long")
    moved = reorder.permute(edges, p)
    assert [r.src for r in moved.orderBy("eid").collect()] == [3, 0, 1, 0, 1]
    assert [r.x for r in files.edges_to_ptr(moved, v).orderBy("pos").collect()] == [0, 0, 2, 4, 5]
    assert reorder.is_permutation(p, 4) and not reorder.is_permutation(p.withColumn("pos", F.lit(0)), 4)
    there = aggregate.spmm(moved, reorder.permute_features(x, p), v, 2)
    assert tuple(validate.mismatches_reordered(there, aggregate.spmm(edges, x, v, 2), p).head()) == (8, 0)


def test_similarity_and_clusters(spark, graph):
    edges, _, v = graph
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    sets = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    pairs = reorder.jaccard_pairs(sets)
    assert {(r.a, r.b): r.jaccard for r in pairs.collect()} == {(0, 3): pytest.approx(1 / 3), (1, 3): 0.5}
    assert {(r.a, r.b): r.jaccard for r in reorder.lsh_pairs(sets, 64, 1).collect()} == {(0, 3): pytest.approx(1 / 3), (1, 3): 0.5}
    named = reorder.clusters(pairs, sets, v)
    assert {r.v: r.root for r in named.collect()} == {0: 1, 1: 1, 2: 2, 3: 1} or len({r.root for r in named.collect()}) == 2
    assert [r.v for r in reorder.cluster_order(named).orderBy("pos").collect()] == [0, 1, 3, 2]


def test_merge_closes_full_clusters():
    members = {i: frozenset([i, 9]) for i in range(4)}
    got = reorder.merge([(0.9, 0, 1), (0.8, 2, 3), (0.7, 1, 2)], members, 2)
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]
    whole = reorder.merge([(0.9, 0, 1), (0.8, 2, 3), (0.7, 1, 2)], members, 64)
    assert len(set(whole.values())) == 1


def test_frontier_and_samples(spark, graph):
    edges, _, _ = graph
    start = spark.createDataFrame([(3,)], "v long")
    assert sorted(r.v for r in sample.frontier(start, edges, 2).collect()) == [0, 2, 3]
    rows, cells = sample.subgraph(sample.frontier(start, edges, 2), edges)
    assert [(r.v, r.begin) for r in rows.orderBy("row").collect()] == [(0, 0), (2, 2), (3, 2)]
    assert [r.src for r in cells.orderBy("eid").collect()] == [1, 2, 0, 2]
    chosen = sample.chosen_neighbours(edges, 1).groupBy("dst").count().collect()
    assert {r.dst: r["count"] for r in chosen} == {0: 1, 1: 1, 3: 1}


def test_lstm(graph):
    edges, x, _ = graph
    w, u = np.arange(16).reshape(2, 8) / 16.0, np.arange(16).reshape(2, 8) / -16.0
    got = [feats(lstm.sage_lstm(edges, x, w, u, 2, bypass)) for bypass in (True, False)]
    assert set(got[0]) == {0, 3} == set(got[1])
    h = c = np.zeros((1, 2))
    for src in (1, 2):
        h, c = lstm.step(np.array([X[src]]) @ w + h @ u, c)
    assert got[0][0] == pytest.approx(tuple(h[0])) and got[1][0] == pytest.approx(tuple(h[0]))


def test_files(spark, graph, tmp_path):
    edges, _, v = graph
    (tmp_path / "g.config").write_text("4 5\n")
    assert tuple(files.read_config(spark, str(tmp_path / "g.config")).head()) == (4, 5)
    (tmp_path / "g.graph").write_text("0 2 3 3 5 \n1 2 0 0 2 \n")
    coo = sorted((r.eid, r.dst, r.src) for r in edges.collect())
    assert sorted((r.eid, r.dst, r.src) for r in files.read_csr_text(spark, str(tmp_path / "g.graph")).collect()) == coo
    np.array(PTR, np.int32).tofile(tmp_path / "g.ptrdump")
    np.array(IDX, np.int32).tofile(tmp_path / "g.edgedump")
    assert sorted((r.eid, r.dst, r.src) for r in files.read_csr_binary(spark, str(tmp_path / "g.ptrdump"), str(tmp_path / "g.edgedump")).collect()) == coo
    files.write_csr_text(edges, v, str(tmp_path / "out"))
    assert sorted((r.eid, r.dst, r.src) for r in files.read_csr_text(spark, str(tmp_path / "out")).collect()) == coo
    assert [(r.src, r.dst) for r in files.edge_index(edges).orderBy("pos").collect()] == [(0, 1), (0, 3), (1, 0), (2, 0), (2, 3)]
    order_ = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "pos long, v long")
    files.write_permutation(order_.repartition(1), str(tmp_path / "perm"))
    (tmp_path / "p.reorder").write_text("2 0 3 1 ")
    assert [(r.pos, r.v) for r in files.read_permutation(spark, str(tmp_path / "p.reorder")).orderBy("pos").collect()] == [(0, 2), (1, 0), (2, 3), (3, 1)]
    files.append_log(spark.createDataFrame([(0.5,)], "s double"), str(tmp_path / "log"))
    files.append_log(spark.createDataFrame([(0.25,)], "s double"), str(tmp_path / "log"))
    assert sorted(float(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()) == [0.25, 0.5]
    assert len(files.peek(edges, 2)) == 2
    (tmp_path / "sizes").write_text("'a': 5,\nb 7\n\n")
    assert {(r.name, r.size) for r in catalog.read_sizes(spark, str(tmp_path / "sizes"), "x").collect()} == {("a", 5), ("b", 7)}


def test_prefix(spark):
    rows = spark.createDataFrame([(i * 3, i % 5) for i in range(500)], "k long, n long")
    want, total = {}, 0
    for i in range(500):
        want[i * 3] = total
        total += i % 5
    assert {r.k: r.p for r in order.exclusive_prefix(rows, "k", "n", "p").collect()} == want


def test_metrics(spark):
    lines = spark.createDataFrame([("DGL time GCN 0.5%",), ("a loss = -1.5e3 b",), ("time x OOM y",)], "value string")
    assert [(r.word, r.number) for r in metrics.token(lines, "time", 4).collect()] == [("0.5%", 0.5), ("y", None)]
    assert [r.n for r in lines.select(metrics.keyed_number(F.col("value"), "loss").alias("n")).collect()] == [None, -1500.0, None]
    labels = spark.createDataFrame([(0.0,), (1e-16,), (2.0,)], "t double").select(metrics.missing_label(F.col("t")).alias("l"))
    assert [r.l for r in labels.collect()] == ["OUT OF MEMORY", "OUT OF SUPPORT", None]


def test_task_records(spark, graph, tmp_path):
    edges, _, _ = graph
    rows = metrics.task_records(edges.repartition(3)).collect()
    assert len(rows) == 3 and sum(r.n_rows for r in rows) == 5 and all(r.begin_ns <= r.end_ns for r in rows)
    (tmp_path / "log").write_text(
        '{"Event":"SparkListenerTaskEnd","Stage ID":2,"Task Info":{"Task ID":7,"Executor ID":"3","Launch Time":10,"Finish Time":15}}\n{"Event":"SparkListenerJobEnd"}\n'
    )
    assert [tuple(r) for r in metrics.event_log_tasks(spark, str(tmp_path / "log")).collect()] == [(7, 2, "3", 10_000_000, 15_000_000)]


def test_api(spark, tmp_path):
    from lattica import __main__, api

    (tmp_path / "g.config").write_text("4 5\n")
    (tmp_path / "g.graph").write_text("0 2 3 3 5\n1 2 0 0 2\n")
    (tmp_path / "p").write_text("2 0 3 1")
    edges, vertices = api.load_graph(spark, str(tmp_path / "g"), reorder=str(tmp_path / "p"))
    assert [r.src for r in edges.orderBy("eid").collect()] == [3, 0, 1, 0, 1] and vertices.count() == 4
    edges, vertices = api.load_graph(spark, str(tmp_path / "g"))
    x = api.features(vertices, 4)
    for model, widths in (("GCN", [4, 3, 2]), ("GAT", [4, 3, 2]), ("GCN_nograph", [4, 2]), ("GAT_nograph", [4, 2]), ("sagelstm", [4, 2])):
        got = feats(api.run(model, edges, x, vertices, api.random_layers(model, widths)))
        assert len(got) == (2 if model == "sagelstm" else 4) and all(len(f) == (4 if model == "sagelstm" else 2) for f in got.values())
    assert schedule.tasks(api.schedule(edges, "neighbor_grouping", 4, group=1)).count() == 5
    with pytest.raises(ValueError):
        api.run("none", edges, x, vertices, [])
    with pytest.raises(ValueError):
        api.load_graph(spark, str(tmp_path / "g"), kind="none")
    __main__.main(["--dataset", "g", "--datadir", str(tmp_path), "--feature-len", "4", "--widths", "2", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
