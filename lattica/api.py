"""The engine's front: load a graph, build features, run a model by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reorder as _reorder
from .operators.schedule import Schedule, tasked
from .plans.models import MODELS
from .plans.rewrite import stack
from .sources import dumps, files
from .sources.scratch import written


def load_graph(spark: SparkSession, path: str, kind: str = "text", reorder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of <path>.config and <path>.graph, of its raw dumps, or of a Parquet cache.

    kind is "text", "binary", "cached" (the dumps, which the first load writes from the text) or "parquet". `reorder` is the
    path of a permutation file; without it, or where there is no such file, the graph keeps its order.
    """
    config = files.read_config(spark, f"{path}.config").head()
    vertices = spark.range(config.num_v).withColumnRenamed("id", "v")
    if kind == "text":
        edges = files.read_csr_text(spark, f"{path}.graph")
    elif kind in ("binary", "cached"):
        arrays = f"{path}.graph.ptrdump", f"{path}.graph.edgedump"
        if kind == "cached" and not all(map(dumps.exists, arrays)):
            # parsed once: pointers, their sum and the neighbours each read the edges
            files.write_csr_binary(written(files.read_csr_text(spark, f"{path}.graph"), "parsed"), vertices, *arrays)
        edges = files.read_csr_binary(spark, *arrays)
    elif kind == "parquet":
        edges = spark.read.parquet(f"{path}.parquet")
    else:
        raise ValueError(f"no such kind of graph file: {kind}")
    if reorder and dumps.exists(reorder):
        edges = _reorder.permute(edges, files.read_permutation(spark, reorder))
    return edges, vertices


def schedule(edges: DataFrame, kind: str, vertices: int, parts: int = 1, group: int = 32) -> DataFrame:
    """Edges with their tasks; kind names a Schedule."""
    return tasked(edges, Schedule(kind), vertices, parts, group)


def random_layers(model: str, widths: list[int], seed: int = 123) -> list:
    """Normal weights for a model: matrices, pairs with attention vectors, or the LSTM's two matrices and its steps."""
    rng = np.random.default_rng(seed)
    if model == "sagelstm":
        width = widths[0]
        return [rng.normal(size=(width, 4 * width)), rng.normal(size=(width, 4 * width)), widths[1]]
    weights = stack(widths, lambda a, b: rng.normal(size=(a, b)))
    return [(w, rng.normal(size=(w.shape[1], 2))) for w in weights] if model.startswith("GAT") else weights


def run(model: str, edges: DataFrame, features: DataFrame, vertices: DataFrame, layers: list) -> DataFrame:
    """features(v, feat) after the model's forward pass."""
    if model not in MODELS:
        raise ValueError(f"no such model: {model}; there are {', '.join(MODELS)}")
    return MODELS[model](edges, features, vertices, layers)


def features(vertices: DataFrame, width: int, seed: int = 123) -> DataFrame:
    return files.random_features(vertices, width, seed).select("v", F.col("feat"))
