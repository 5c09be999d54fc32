"""Choices that Catalyst cannot make, because they need algebra: which of two equal plans to build."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..operators.aggregate import spmm
from ..operators.dense import matmul


@dataclass(frozen=True)
class Linear:
    """A neighbour sum and a dense product, in either order: A (X W) = (A X) W."""

    weights: np.ndarray
    weighted: bool = False

    def dense_first(self) -> bool:
        """The narrower vectors are the ones to move over edges."""
        before, after = np.asarray(self.weights).shape
        return after <= before

    def apply(self, edges: DataFrame, features: DataFrame, vertices: DataFrame, dense_first: bool | None = None) -> DataFrame:
        before, after = np.asarray(self.weights).shape
        if self.dense_first() if dense_first is None else dense_first:
            return spmm(edges, matmul(features, self.weights), vertices, after, self.weighted)
        return matmul(spmm(edges, features, vertices, before, self.weighted), self.weights)


def stack(widths: list[int], make) -> list[np.ndarray]:
    """Weight matrices make(width in, width out) of consecutive layers."""
    return [make(a, b) for a, b in zip(widths, widths[1:], strict=False)]
