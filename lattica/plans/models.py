"""Forward passes: graph convolution, graph attention, neighbour LSTM, and their parts without the graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attention import attention_pair, gat_aggregate
from ..operators.dense import matmul
from ..operators.lstm import sage_lstm
from ..sources.scratch import written
from .rewrite import Linear


def relu_rows(features: DataFrame) -> DataFrame:
    return features.select("v", F.transform("feat", lambda x: F.greatest(x, F.lit(0.0))).alias("feat"))


def gcn_layer(edges: DataFrame, features: DataFrame, vertices: DataFrame, weights: np.ndarray) -> DataFrame:
    """relu(A (X W)): an unweighted sum, without degrees, loops or bias."""
    return relu_rows(Linear(weights).apply(edges, features, vertices))


def gcn(edges: DataFrame, features: DataFrame, vertices: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    if len(layers) > 1:
        edges = written(edges, "edges")  # every layer reads them
    for weights in layers:
        features = gcn_layer(edges, features, vertices, weights)
    return features


def gat_layer(edges: DataFrame, features: DataFrame, vertices: DataFrame, weights: np.ndarray, attention: np.ndarray, slope: float = 0.2) -> DataFrame:
    """H = X W, scores H a (a column for receivers, one for sources), attention-weighted sums of H."""
    h = written(matmul(features, weights), "layer")
    pair = attention_pair(h, list(attention[:, 0]), list(attention[:, 1]))
    return gat_aggregate(edges, h, pair, vertices, np.asarray(weights).shape[1], slope)


def gat(edges: DataFrame, features: DataFrame, vertices: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], slope: float = 0.2) -> DataFrame:
    """Layers in turn; each layer's product is written, as scores and sums read it three times."""
    if len(layers) > 1:
        edges = written(edges, "edges")
    for weights, attention in layers:
        features = gat_layer(edges, features, vertices, weights, attention, slope)
    return features


def dense_only(features: DataFrame, layers: list[np.ndarray], relu: bool = True) -> DataFrame:
    """A model's dense part alone."""
    for weights in layers:
        features = matmul(features, weights, relu)
    return features


#: Name -> function of (edges, features, vertices, layers).
MODELS = {
    "GCN": gcn,
    "GAT": gat,
    "sagelstm": lambda edges, features, vertices, layers: sage_lstm(edges, features, *layers),
    "GCN_nograph": lambda edges, features, vertices, layers: dense_only(features, layers),
    "GAT_nograph": lambda edges, features, vertices, layers: dense_only(features, [w for w, _ in layers], relu=False),
}
