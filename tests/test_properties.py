"""Random small graphs against plain numpy, and equalities between ways to compute the same."""

from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lattica.operators import aggregate, attention, sample, schedule
from lattica.operators.schedule import Schedule

GRAPH = st.integers(2, 8).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(-4, 4)), max_size=20)))
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, n, rows):
    cells = sorted(rows)
    edges = spark.createDataFrame([(i, d, s, float(w)) for i, (d, s, w) in enumerate(cells)], "eid long, dst long, src long, val double")
    x = np.array([[(v * 7 + k * 3) % 11 - 5 for k in range(3)] for v in range(n)], float)
    return cells, edges, x, spark.createDataFrame([(v, [float(t) for t in x[v]]) for v in range(n)], "v long, feat array<double>")


@FEW
@given(GRAPH)
def test_sums_and_schedules(spark, graph):
    n, rows = graph
    cells, edges, x, features = frames(spark, n, rows)
    want = np.zeros((n, 3))
    for d, s, w in cells:
        want[d] += w * x[s]
    vertices = features.select("v")
    assert {r.v: r.feat for r in aggregate.spmm(edges, features, vertices, 3).collect()} == {v: list(want[v]) for v in range(n)}
    tasked = schedule.tasked(edges, Schedule.LOCALITY_NEIGHBOR_GROUPING, n, 2, 2)
    assert {r.v: r.feat for r in aggregate.spmm_grouped(edges, features, vertices, 3, parts=2, share=4).collect()} == {v: list(want[v]) for v in range(n)}
    table = schedule.tasks(tasked).orderBy("task_id").collect()
    assert sum(r.size for r in table) == len(cells) and [r.task_id for r in table] == list(range(len(table))) and all(1 <= r.size <= 2 for r in table)


@FEW
@given(GRAPH, st.integers(1, 3))
def test_softmax_and_samples(spark, graph, limit):
    n, rows = graph
    cells, edges, _, _ = frames(spark, n, rows)
    attn = spark.createDataFrame([(v, v / 4.0, -v / 8.0) for v in range(n)], "v long, a_dst double, a_src double")
    total: dict[int, float] = {}
    for r in attention.edge_softmax(edges, attn).collect():
        total[r.dst] = total.get(r.dst, 0) + r.p
    assert all(abs(t - 1) < 1e-9 for t in total.values()) and set(total) == {d for d, _, _ in cells}
    chosen = [(r.dst, r.src) for r in sample.chosen_neighbours(edges, limit).collect()]
    around = {d: {s for e, s, _ in cells if e == d} for d, _, _ in cells}
    assert len(chosen) == len(set(chosen)) and all(s in around[d] for d, s in chosen)
    assert {d: sum(1 for e, _ in chosen if e == d) for d in around} == {d: min(len(s), limit) for d, s in around.items()}
