"""Neighbour samples: every neighbour as likely as any other, and any two as likely together; hubs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.operators import sample


def test_inclusion_over_seeds(spark):
    """2,000 seeds, a vertex with sources 0 to 99, 8 of them: inclusions lie within 4 standard errors of 0.08, pairs within 5 of
    their chance, runs of consecutive ids are as rare as they should be."""
    seeds, degree, limit = 2000, 100, 8
    rows = spark.range(seeds).select(F.col("id").alias("seed")).crossJoin(spark.range(degree).select(F.col("id").alias("src")))
    order = Window.partitionBy("seed").orderBy(sample.sample_key(F.lit(7), F.col("src"), F.col("seed")), "src")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).toPandas()
    held = np.zeros((seeds, degree))
    held[picked.seed, picked.src] = 1
    p = limit / degree
    assert np.abs(held.mean(0) - p).max() < 4 * np.sqrt(p * (1 - p) / seeds)
    both = (held.T @ held) / seeds
    chance = p * (limit - 1) / (degree - 1)
    off = both[~np.eye(degree, dtype=bool)]
    assert np.abs(off - chance).max() < 5 * np.sqrt(chance * (1 - chance) / seeds) and abs(off.mean() - chance) < 1e-12
    next_to = (held[:, 1:] * held[:, :-1]).sum(1).mean()
    assert abs(next_to - 99 * chance) < 0.1


def test_a_hub_and_odd_vertices(spark):
    edges = spark.range(20_000).select(F.col("id").alias("eid"), F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(9).alias("dst"), (F.col("id") % 15_000).alias("src"))
    edges = edges.unionByName(spark.createDataFrame([(-1, 1 << 40, 1 << 41), (-2, 1 << 40, 1 << 41), (-3, -5, -6)], "eid long, dst long, src long"))
    for seed in (0, 3):
        got = sample.chosen_neighbours(edges, 8, seed).collect()
        around = {}
        for r in edges.select("dst", "src", sample.sample_key(F.col("dst"), F.col("src"), seed).alias("h")).distinct().collect():
            around.setdefault(r.dst, []).append((r.h, r.src))
        want = {(d, s) for d, row in around.items() for _, s in sorted(row)[:8]}
        assert {(r.dst, r.src) for r in got} == want and len(got) == len(want)


def test_tasks_follow_the_number_of_edges(spark, monkeypatch):
    edges = spark.range(6000).select((F.col("id") % 40).alias("dst"), (F.col("id") * 7 % 1500).alias("src"), F.col("id").alias("eid"))
    pairs = lambda df: {(r.dst, r.src) for r in df.collect()}
    want = pairs(sample.chosen_neighbours(edges, 8))
    monkeypatch.setattr(sample, "TASK_ROWS", 100)
    many = sample.chosen_neighbours(edges, 8)
    assert pairs(many) == want and many.rdd.getNumPartitions() == 60
