"""Work decomposition: tasks of bounded size, by source range, by chunks of neighbours, or both."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import exclusive_prefix, number_rows, position_in_row


class Schedule(Enum):
    LOCALITY = "locality"
    NEIGHBOR_GROUPING = "neighbor_grouping"
    LOCALITY_NEIGHBOR_GROUPING = "locality_neighbor_grouping"
    NOP = "nop"


def tasked(edges: DataFrame, kind: Schedule, vertices: int, parts: int = 1, group: int = 32) -> DataFrame:
    """Adds part (source range), grp (chunk of `group` neighbours) and task_id (dense, by part, dst, grp) to the edges.

    Ranges are vertices // parts wide and the last takes the rest. Rows without edges have no task. `eid` is the CSR
    position, so without ranges an edge's place in its row is its distance from the row's first edge: a row of any
    degree is not sorted in one task.
    """
    if kind is Schedule.NEIGHBOR_GROUPING:
        ends = edges.groupBy("dst").agg(F.min("eid").alias("__begin"), (F.floor((F.max("eid") - F.min("eid")) / group) + 1).alias("__n"))
        first = exclusive_prefix(ends, "dst", "__n", "__first").select("dst", "__begin", "__first")
        grp = F.floor((F.col("eid") - F.col("__begin")) / group).cast("long")
        rows = edges.join(first, "dst").withColumn("part", F.lit(0).cast("long")).withColumn("grp", grp)
        return rows.withColumn("task_id", F.col("__first") + F.col("grp")).drop("__begin", "__first")
    ranged = kind in (Schedule.LOCALITY, Schedule.LOCALITY_NEIGHBOR_GROUPING)
    chunked = kind in (Schedule.NEIGHBOR_GROUPING, Schedule.LOCALITY_NEIGHBOR_GROUPING)
    width = max(1, vertices // parts)
    part = F.least(F.floor(F.col("src") / width), F.lit(parts - 1)) if ranged else F.lit(0)
    rows = edges.withColumn("part", part.cast("long"))
    rows = position_in_row(rows, "__place", ("part", "dst"))
    rows = rows.withColumn("grp", (F.floor(F.col("__place") / group) if chunked else F.lit(0)).cast("long")).drop("__place")
    rows = rows.withColumn("__row", F.col("part") * vertices + F.col("dst"))
    counts = rows.groupBy("__row").agg((F.max("grp") + 1).alias("__n"))
    first = exclusive_prefix(counts, "__row", "__n", "__first").select("__row", "__first")
    return rows.join(first, "__row").withColumn("task_id", F.col("__first") + F.col("grp")).drop("__row", "__first")


def tasks(rows: DataFrame) -> DataFrame:
    """task_id, dst, part, grp, size, ptr: a row per task; ptr is where its edges begin in task order."""
    sized = rows.groupBy("task_id", "dst", "part", "grp").agg(F.count("*").alias("size"))
    return exclusive_prefix(sized, "task_id", "size", "ptr")


def task_edges(rows: DataFrame) -> DataFrame:
    """pos, task_id, src, val: the edges in task order, neighbours of a task in their old order."""
    return number_rows(rows, ["task_id", "eid"], "pos").select("pos", "task_id", "src", "val")


def task_stats(per_task: DataFrame, small: int = 32) -> DataFrame:
    """n_tasks, n_edges, least, most, n_small (below `small`), n_empty."""
    return per_task.agg(
        F.count("*").alias("n_tasks"), F.sum("size").alias("n_edges"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.sum((F.col("size") < small).cast("long")).alias("n_small"), F.sum((F.col("size") == 0).cast("long")).alias("n_empty"),
    )
