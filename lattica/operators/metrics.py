"""Timings and run logs: balance, means, normalised tables, text extraction."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a missing run, and one that a framework can't do, count as in tables of timings.
MISSING, UNSUPPORTED = 0.0, 1e-16


def task_records(df: DataFrame) -> DataFrame:
    """task_id, begin_ns, end_ns, n_rows: when each task of a plan's last stage began and ended to read its rows, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = time.time_ns()
        rows = sum(b.num_rows for b in batches)
        context = TaskContext.get()
        yield pa.RecordBatch.from_pylist([{"task_id": context.partitionId(), "begin_ns": began, "end_ns": time.time_ns(), "n_rows": rows}])

    return df.mapInArrow(run, "task_id long, begin_ns long, end_ns long, n_rows long")


def event_log_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id, stage, executor, begin_ns, end_ns of the finished tasks in a Spark event log."""
    ends = spark.read.text(path).where(F.col("value").contains('"SparkListenerTaskEnd"'))
    field = lambda p: F.get_json_object("value", p)
    at = "$['Task Info']"
    return ends.select(
        field(f"{at}['Task ID']").cast("long").alias("task_id"), field("$['Stage ID']").cast("long").alias("stage"), field(f"{at}['Executor ID']").alias("executor"),
        (field(f"{at}['Launch Time']").cast("long") * 1_000_000).alias("begin_ns"), (field(f"{at}['Finish Time']").cast("long") * 1_000_000).alias("end_ns"),
    )


def balance(timers: DataFrame, slots: int) -> DataFrame:
    """balanced, actual: busy time over slots, and from the first begin to the last end, of timers(begin_ns, end_ns)."""
    return timers.agg((F.sum(F.col("end_ns") - F.col("begin_ns")) / slots).alias("balanced"), (F.max("end_ns") - F.min("begin_ns")).alias("actual"))


def last_by_slot(timers: DataFrame, n: int) -> DataFrame:
    """Each slot's n latest tasks, latest first."""
    order = Window.partitionBy("slot").orderBy(F.desc("end_ns"), "task_id")
    return timers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def mean_runs(runs: DataFrame, warm_up: int = 3) -> DataFrame:
    """name, mean over runs(name, run, seconds) past the warm-up (runs count from 0)."""
    return runs.where(F.col("run") >= warm_up).groupBy("name").agg(F.avg("seconds").alias("mean"))


def over_greatest(rows: DataFrame, by: str, value: str, out: str = "share", least: float = 0.0) -> DataFrame:
    """value over its partition's greatest (plus `least`, against division by 0)."""
    return rows.withColumn(out, F.col(value) / (F.max(value).over(Window.partitionBy(by)) + F.lit(least)))


def over_baseline(rows: DataFrame, by: str, variant: str, baseline: str, value: str) -> DataFrame:
    """share: value over the baseline variant's; above: the difference to 1 that a stacked bar shows."""
    base = F.max(F.when(F.col(variant) == baseline, F.col(value))).over(Window.partitionBy(by))
    return rows.withColumn("share", F.col(value) / base).withColumn("above", F.col("share") - 1)


def token(lines: DataFrame, keyword: str, k: int, value: str = "value") -> DataFrame:
    """The k-th word (from 1) of lines that hold a keyword, and as a number where it is one."""
    word = F.get(F.split(F.trim(value), r"\s+"), F.lit(k - 1))
    return lines.where(F.contains(F.col(value), F.lit(keyword))).withColumn("word", word).withColumn("number", strip_percent(F.col("word")).try_cast("double"))


def strip_percent(text: Column) -> Column:
    return F.regexp_replace(text, "%", "")


def keyed_number(text: Column, name: str) -> Column:
    """The number after name= or name = in a line."""
    return F.regexp_extract(text, name + r"\s*=\s*([-+0-9.eE]+)", 1).try_cast("double")


def result_matrix(results: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """dataset x app rows with a column per framework, of those named or else of all that occur; text that is no number
    counts as 0, then at least 1e-16."""
    number = F.greatest(F.coalesce(F.col("text").try_cast("double"), F.lit(MISSING)), F.lit(UNSUPPORTED))
    return results.withColumn("number", number).groupBy("app", "dataset").pivot("framework", frameworks).agg(F.max("number"))


def axis_facts(results: DataFrame, by: str, value: str) -> DataFrame:
    """greatest, second, least_positive, log_axis (greatest over 100 x second) by partition."""
    order = Window.partitionBy(by).orderBy(F.desc(value))
    ranked = results.withColumn("__n", F.row_number().over(order))
    facts = ranked.groupBy(by).agg(F.max(value).alias("greatest"), F.max(F.when(F.col("__n") == 2, F.col(value))).alias("second"), F.min(F.when(F.col(value) > 0, F.col(value))).alias("least_positive"))
    return facts.withColumn("log_axis", F.coalesce(F.col("greatest") / F.col("second") > 100, F.lit(False)))


def missing_label(value: Column) -> Column:
    return F.when(value == MISSING, F.lit("OUT OF MEMORY")).when(value == UNSUPPORTED, F.lit("OUT OF SUPPORT"))


def every_other(lines: DataFrame, position: str) -> DataFrame:
    """The even lines, counted from 1 by position."""
    return lines.where(F.col(position) % 2 == 0)


def last_element(path: Column) -> Column:
    """The name after a path's last slash."""
    return F.element_at(F.split(path, "/"), -1)
