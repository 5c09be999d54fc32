"""Scalar column expressions and fixed-length vector expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest vectors whose sums are spelled out term by term, which keeps them inside generated code; longer code is not compiled.
UNROLL = 16


def leaky_relu(z: Column, slope: float = 0.2) -> Column:
    return F.greatest(z, z * F.lit(float(slope)))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tanh(z: Column) -> Column:
    return F.tanh(z)


def guarded_divide(x: Column, s: Column) -> Column:
    """x / s where s is not 0, else x."""
    return F.when(s != 0, x / s).otherwise(x)


def dot(a: Column, b: Column, width: int) -> Column:
    """Inner product of two vectors of the given width."""
    if width <= UNROLL:
        return reduce(lambda x, y: x + y, [F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(width)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def gflops(edges: Column, width: Column, seconds: Column) -> Column:
    """Billions of operations a second of a neighbour sum: two per edge and feature."""
    return F.lit(2.0) * edges * width / seconds / F.lit(1e9)
