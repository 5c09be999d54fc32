"""Row-major dense products. A vertex's vector meets the whole weight matrix, which is a model parameter of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(features: DataFrame, weights: np.ndarray, relu: bool = False) -> DataFrame:
    """features(v, feat) times weights [in x out], in Arrow batches; optionally ReLU on the way out."""
    w = np.asarray(weights, np.float64)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in features.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("feat")
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ w
            x = np.maximum(x, 0.0) if relu else x
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield batch.set_column(at, "feat", pa.ListArray.from_arrays(ends, pa.array(x.ravel())))

    return features.mapInArrow(run, schema)


def matmul_long(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(v, k, x) joined with weights(i, o, w): the product as algebra, (v, o, y)."""
    return long.join(F.broadcast(weights), F.col("k") == F.col("i")).groupBy("v", "o").agg(F.sum(F.col("x") * F.col("w")).alias("y"))
