"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import note

PACKAGE = Path(__file__).resolve().parent.parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where a local session has none."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = note(spark, new_folder(spark, name))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, so that they need no copy of their own. Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "lattica.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(os.path.abspath(out))
    sc._lattica_shipped = True


def open_store(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where a text column passes so many bytes, so that Python lists of words stay small."""
    for batch in batches:
        lengths = batch.column(column).nbytes
        if lengths <= most:
            if batch.num_rows:
                yield batch
            continue
        rows = max(1, batch.num_rows * most // lengths)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker serves many tasks: what a task has freed goes back to the system when it ends. Meanwhile the cycle
    collector rests; the operators make no cycles, and it would scan their word tables again and again."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if with_trim:
                with_trim(0)

    return wrapped
