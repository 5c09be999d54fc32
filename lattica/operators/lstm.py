"""LSTM over a vertex's neighbours in row order. Gates lie side by side: output, candidate, forget, input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import gather_steps
from .dense import matmul


def step(gates: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New h and c of a batch from its gate sums."""
    o, g, f, i = np.split(gates, 4, axis=1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
    return sigmoid(o) * np.tanh(c), c


def fold(rows: DataFrame, recurrent: np.ndarray, steps: int, weights: np.ndarray | None = None) -> DataFrame:
    """features(v, feat): the last h of each vertex of (dst, step, feat) with exactly `steps` vectors, from zero h and c.

    With `weights` the vectors are inputs and are multiplied here, once per step; else they are gate sums already. Steps
    reach Python as rows, sorted by vertex and place, so an Arrow batch holds 10,000 vectors and not as many sequences of
    them. The fold is sequential in the steps and runs over all vertices of a batch at once; the last one waits for the
    next batch, which may hold the rest of it.
    """
    width = np.asarray(recurrent).shape[0]
    inputs = 4 * width if weights is None else np.asarray(weights).shape[0]
    whole = rows.where(F.col("dst").isNotNull() & (F.size("feat") == inputs)).select(F.col("dst").cast("long").alias("v"), "step", "feat")

    def folded(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, first, count = np.unique(ids, return_index=True, return_counts=True)
        v, first = v[count == steps], first[count == steps]
        if not len(v):
            return
        h = c = np.zeros((len(v), width))
        for t in range(steps):
            at = x[first + t]
            h, c = step((at if weights is None else at @ weights) + h @ recurrent, c)
        ends = pa.array(np.arange(0, h.size + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.ListArray.from_arrays(ends, pa.array(h.ravel()))], ["v", "feat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.empty(0, np.int64), np.empty((0, inputs))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column("v").to_numpy()])
            x = np.concatenate([x, batch.column("feat").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)])
            last = np.searchsorted(ids, ids[-1])
            yield from folded(ids[:last], x[:last])
            ids, x = ids[last:].copy(), x[last:].copy()
        yield from folded(ids, x)

    # Dealt by a digest: rows that a join has dealt by v already would not be dealt again, and once that join is a broadcast
    # they are read where they were written, a vertex in several tasks.
    return whole.repartition(F.xxhash64("v")).sortWithinPartitions("v", "step").mapInArrow(run, "v long, feat array<double>")


def sage_lstm(edges: DataFrame, features: DataFrame, weights: np.ndarray, recurrent: np.ndarray, steps: int, bypass: bool = True) -> DataFrame:
    """LSTM over each vertex's first `steps` neighbours; vertices with fewer have no row.

    With `bypass` every vertex is multiplied by the input weights once, and products are gathered; else inputs are
    gathered and multiplied once per edge.
    """
    source = matmul(features, weights) if bypass else features
    kept = gather_steps(edges, source).where(F.col("step") < steps)
    return fold(kept, recurrent, steps, None if bypass else weights)
