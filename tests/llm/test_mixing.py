from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing


def targets(sizes: dict, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


CASES = [{"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"z": 0, "y": 50, "Z": 3, "é": 900, "e": 2}, {None: 12}, {str(i): (i * 37) % 101 for i in range(40)}, {"a": 0, "b": 0}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.allocate(frame).collect()}
    want = targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}


def table(spark, n=3000):
    rows = [(i, ["hot", "hot", "a", "b", None, "c"][i % 6] if i % 11 else "tiny%d" % (i % 3), ["w " * (i * 7919 % 90), None, "", "one", "a\tb\x0bc d"][i % 5 if i % 7 == 0 else 0], i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, size int").repartition(5)


def test_mix(spark):
    rows, docs = table(spark)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t, _ in rows}
    whole: dict = {}
    for i, s, _, _ in rows:
        whole[s] = whole.get(s, 0) + size[i]
    target = targets(whole)
    taken = dict.fromkeys(whole, 0)
    for i, s, _, _ in rows:
        r = got[i]
        assert r.size == size[i] and r.source_size == whole[s] and r.target == pytest.approx(target[s])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        assert abs(r.copies - target[s] / whole[s]) < 1 or r.copies in (int(target[s] / whole[s]), int(target[s] / whole[s]) + 1)
        taken[s] += r.taken
    for s in whole:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]), (s, taken[s], target[s])
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {i: r.copies for i, r in got.items()}
    assert {r.doc_id: r.copies for r in mixing.mix(docs, seed=1).collect()} != again


def test_joins_without_broadcast_agree(spark, monkeypatch):
    _, docs = table(spark, 300)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", -1)
    assert {r.doc_id: r.copies for r in mixing.mix(docs).collect()} == want


def test_odd_tables(spark):
    _, docs = table(spark, 30)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(1, "a", "x y")] * 4 + [(None, "b", "x")] * 3, "doc_id long, source string, text string")
    rows = mixing.mix(twice).collect()
    assert len(rows) == 7 and all(r.taken <= 3 * r.size for r in rows)


@pytest.mark.parametrize("favoured", [False, True])
def test_each_document_is_drawn_as_often_as_its_probability(spark, favoured):
    """1,600 sources of the same sizes are as many draws, half of them with either target. Document by document the share of
    draws that hold it is p within 4 standard errors (0.017 each) and the 0.03 by which the words left over at the end of a draw
    of some 250 favour short documents; with favoured documents, p follows from the odds and the words to draw."""
    sizes, weight = [1 + i % 9 for i in range(150)], [0.5, 1.0, 3.0]
    n, row = len(sizes), F.col("id")
    docs = spark.range(1600 * n).select(
        row.alias("doc_id"), F.format_string("s%04d", F.floor(row / n)).alias("source"), F.repeat(F.lit("w "), F.get(F.array(*[F.lit(k) for k in sizes]), (row % n).cast("int"))).alias("text"),
        F.get(F.array(*[F.lit(w) for w in weight]), F.floor(row % n / 50).cast("int")).alias("liked"),
    )
    got = mixing.mix(docs, weights=(1, 2), favour="liked" if favoured else None).select((F.col("doc_id") % n).alias("place"), F.col("source_size"), "target", "copies").toPandas()
    s = np.array(sizes, float)
    for share, drawn in got.groupby(got.target < got.source_size):
        part = 2 / 3 if share else 1 / 3
        odds = part / (1 - part) * np.repeat(weight if favoured else [1.0] * 3, 50)
        low, high = 1e-3, 1e3
        for _ in range(100):  # the factor with which the expected words are those to draw
            c = (low * high) ** 0.5
            p = c * odds / (1 + c * odds)
            low, high = (c, high) if (p * s).sum() < part * s.sum() else (low, c)
        assert favoured or np.allclose(p, part)
        found = (drawn.copies - (0 if share else 1)).groupby(drawn.place).mean().to_numpy()
        assert np.abs(found - p).max() < 0.098 and abs((found - p).mean()) < 0.01
        assert max(abs((found - p)[s == k].mean()) for k in range(1, 10)) < 0.04


def test_what_fits_comes_in_order_of_rank(spark):
    """Without documents that are too long for it, a draw leaves less than its smallest document open."""
    sizes = [400, 300, 7, 90, 33, 5, 2, 1, 1, 120, 64, 16, 8, 3, 250, 41]
    docs = spark.createDataFrame([(i * 100 + j, "ab"[i % 2], "w " * n) for i in range(6) for j, n in enumerate(sizes)], "doc_id long, source string, text string")
    for seed in range(4):
        got = mixing.mix(docs, seed=seed).toPandas()
        got = got.groupby(got.doc_id // 100 % 2).agg({"taken": "sum", "target": "max"})
        assert ((got.target - got.taken) >= -1e-6).all() and ((got.target - got.taken) < 40).all()
