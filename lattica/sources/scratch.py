"""Tables written between steps: they cut the lineage, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share; a local session without one gets a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lattica-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def note(spark: SparkSession, path: str) -> str:
    """Remembers a folder that clear() may delete."""
    context = spark.sparkContext
    context._lattica_scratch = [*getattr(context, "_lattica_scratch", []), path]
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the tables that steps have written in this session, and returns how many there were. For a long session,
    between queries: results that were not collected or written yet are lost."""
    context = spark.sparkContext
    paths, context._lattica_scratch = getattr(context, "_lattica_scratch", []), []
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back: what uses it several times doesn't compute it again."""
    path = note(df.sparkSession, scratch(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
