"""Numbering and prefix sums by ranges: sparse keys, long rows, and how many rows the only window over everything has."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import order


@pytest.fixture
def ranges(spark, monkeypatch):
    """Many small ranges, and the row counts of the tables that the window over everything sees."""
    seen, old = [], order._starts

    def starts(ranged):
        out = old(ranged)
        seen.append((out.count(), ranged.select("__part").distinct().count()))
        return out

    monkeypatch.setattr(order, "_starts", starts)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield seen
    for k, v in saved.items():
        spark.conf.set(k, v)


def test_sparse_keys(spark, ranges):
    rng = random.Random(4)
    keys = sorted({rng.randrange(-(10**15), 10**15) for _ in range(3000)} | {10**15, -(10**15), 0, 1, 2, 3})
    rows = spark.createDataFrame([(k, k % 7, "x") for k in keys], "k long, n int, other string").repartition(5)
    got = order.number_rows(rows, "k", "i")
    assert {r.k: r.i for r in got.collect()} == {k: i for i, k in enumerate(keys)} and got.columns == ["k", "n", "other", "i"]
    want, total = {}, 0
    for k in keys:
        want[k], total = total, total + k % 7
    got = order.exclusive_prefix(rows, "k", "n", "p")
    assert {r.k: r.p for r in got.collect()} == want and got.columns == ["k", "n", "other", "p"]
    assert all(windowed == parts <= 13 for windowed, parts in ranges) and len(ranges) == 2


def test_two_keys_nulls_and_empty(spark, ranges):
    rows = [(a, b, None if b == 2 else b) for a in (3, 1, 10**12) for b in range(4)]
    frame = spark.createDataFrame(rows, "a long, b long, n long")
    assert {(r.a, r.b): r.i for r in order.number_rows(frame, ["a", "b"], "i").collect()} == {k: i for i, k in enumerate(sorted((a, b) for a, b, _ in rows))}
    want, total = {}, 0
    for a, b, n in sorted(rows, key=lambda r: r[:2]):
        want[a, b], total = total, total + (n or 0)
    assert {(r.a, r.b): r.p for r in order.exclusive_prefix(frame, ["a", "b"], "n", "p").collect()} == want
    assert order.number_rows(frame.where("a < 0"), "a", "i").count() == 0 == order.exclusive_prefix(frame.where("a < 0"), "a", "n", "p").count()


def test_a_long_row_lies_in_many_ranges(spark, ranges):
    """Nine tenths of the edges reach one vertex; places in its row need no task that holds it whole."""
    edges = spark.range(4000).select((F.col("id") * 17).alias("eid"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("dst"), ((F.col("id") * 7919) % 4001).alias("src"))
    rows = edges.collect()
    by_row = {}
    for r in sorted(rows, key=lambda r: (r.dst, r.src)):
        by_row.setdefault(r.dst, []).append(r.eid)
    got = {r.eid: r.step for r in order.position_in_row(edges, order=("src",)).collect()}
    assert got == {e: i for row in by_row.values() for i, e in enumerate(row)}
    numbered = order.number_rows(edges, ["dst", "eid"], "n")
    largest = numbered.groupBy(F.floor(F.col("n") / 1)).count().count()
    assert largest == 4000 and ranges[-1][1] == 13


def test_edges_are_numbered_by_one_number_in_the_order_of_both_ends(spark, tmp_path, monkeypatch):
    """Sorting by two columns compares rows of the same receiver with each other; nulls and negative ends keep their places."""
    from lattica import fixtures as fx

    spark.range(50).selectExpr("id AS vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    ends = [None, *range(-130, 131, 7), 2**60 + 3, -(2**60)]
    rows = [(p, o, s) for p in ends for o, s in ((None, 1), (-9, 4), (0, 0), (7, 1), (7, 1), (10**12, 3))]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys, number = [], order.number_rows
    monkeypatch.setattr(fx, "number_rows", lambda df, key, out: keys.append([dict(df.dtypes)[k] for k in ([key] if isinstance(key, str) else key)]) or number(df, key, out))
    got = fx.edges(spark, str(tmp_path))
    assert keys == [["bigint"]] and got.dtypes == [("eid", "bigint"), ("dst", "bigint"), ("src", "bigint"), ("val", "double")]
    want = sorted((tuple(r) for r in fx.plain_edges(spark, str(tmp_path)).collect()), key=lambda r: [(x is not None, x or 0) for x in r[:2]])
    assert [tuple(r) for r in got.orderBy("eid").collect()] == [(i, *r) for i, r in enumerate(want)]
    assert None in {r[0] for r in want} and None in {r[1] for r in want} and min(r[0] for r in want if r[0] is not None) < 0
