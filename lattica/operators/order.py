"""Prefix sums and dense numbering by ranges of keys: no window over the whole table, and none over a long row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import written

#: monotonically_increasing_id holds a partition's number above so many bits, and a row's place in it below.
PLACE_BITS = 33


def _starts(ranged: DataFrame) -> DataFrame:
    """__part, __start: what lies before each partition of (__part, __sum). The one window over all has a row per partition."""
    sums = ranged.groupBy("__part").agg(F.sum("__sum").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("__part", F.coalesce(before, F.lit(0)).cast("long").alias("__start"))


def number_rows(df: DataFrame, key: str | Sequence[str], out: str) -> DataFrame:
    """Numbers rows densely from 0 by ascending key columns, which may be of any kind and as sparse as they like.

    Rows are dealt into ranges of keys (split points are sampled), sorted there, and written with their place; ranges are
    counted, and each row adds what lies before its range. One shuffle, whatever the keys; rows equal in all key columns
    come in any order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__at", PLACE_BITS))
    starts = _starts(placed.select("__part", F.lit(1).alias("__sum")))
    inside = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + inside).drop("__at", "__part", "__start")


def exclusive_prefix(df: DataFrame, key: str | Sequence[str], value: Column | str, out: str) -> DataFrame:
    """Adds the sum of `value` (a long; null counts as 0) over all rows with a smaller key; keys are distinct.

    As number_rows, with a running sum in place of a place: each range is added up in Arrow batches as it is sorted, and
    the ranges' sums, a row per partition, are the only window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    column = F.col(value) if isinstance(value, str) else value
    marked = df.withColumn("__sum", F.coalesce(column.cast("long"), F.lit(0)))
    sorted_ = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            upto = total + np.cumsum(batch.column("__sum").to_numpy())
            before = np.concatenate([[total], upto[:-1]])
            total = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "__before"])

    schema = StructType([*sorted_.schema.fields, StructField("__before", LongType())])
    placed = written(sorted_.mapInArrow(run, schema), "prefixed")
    return placed.join(F.broadcast(_starts(placed)), "__part").withColumn(out, F.col("__start") + F.col("__before")).drop("__sum", "__part", "__start", "__before")


def position_in_row(edges: DataFrame, out: str = "step", by: Sequence[str] = ("dst",), order: Sequence[str] = ("eid",)) -> DataFrame:
    """Adds each edge's place, from 0, among its row's edges: its number in the whole order less its row's first. A long row
    lies in as many ranges as its length asks for. Where `eid` numbers the edges row by row, it is that number already."""
    numbered = edges.withColumn("__n", F.col("eid")) if (tuple(by), tuple(order)) == (("dst",), ("eid",)) else number_rows(edges, [*by, *order], "__n")
    first = numbered.groupBy(*by).agg(F.min("__n").alias("__first"))
    return numbered.join(first, list(by)).withColumn(out, F.col("__n") - F.col("__first")).drop("__n", "__first")


def compacted(active: DataFrame, sizes: DataFrame, v: str = "v", size: str = "deg") -> DataFrame:
    """row, v, begin, deg: active vertices numbered densely, with the exclusive prefix of their sizes (0 where none is known)."""
    kept = active.select(v).distinct().join(sizes.select(v, size), v, "left").withColumn(size, F.coalesce(size, F.lit(0)).cast("long"))
    return exclusive_prefix(number_rows(kept, v, "row"), v, size, "begin").select("row", v, "begin", size)
