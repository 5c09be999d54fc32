"""Arrays of native 32-bit integers on disk, read and written in parts: a data source that plans ranges of bytes.

An array is one file, or a folder of part files that follow each other in the order of their names. A reader's task has a
range of one file, whatever the file's size; a writer's task has a range of positions and writes one part, which takes its
place when the whole write is committed, so a lost task leaves nothing behind.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, and numbers of a batch.
RANGE, BATCH = 1 << 25, 1 << 16
WIDTH = 4


def _store(path: str):
    """pyarrow's file system of a path or URI, and the path in it. A path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))


def _parts(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of an array, in order; none where there is nothing."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type != fs.FileType.Directory:
        return []
    files = store.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def exists(path: str) -> bool:
    """Whether there is a file, or a folder that a write has been committed to."""
    from pyarrow import fs

    store, at = _store(path)
    kind = store.get_file_info(at).type
    return kind == fs.FileType.File or (kind == fs.FileType.Directory and store.get_file_info(f"{at}/_SUCCESS").type == fs.FileType.File)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range", RANGE)) // WIDTH * WIDTH

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for file, size in _parts(self.path):
            if size % WIDTH:
                raise ValueError(f"{file} holds no whole number of 32-bit integers")
            out += [Range(file, at, min(at + self.size, size), (before + at) // WIDTH) for at in range(0, size, self.size)]
            before += size
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            f.seek(part.start)
            left, pos = part.end - part.start, part.first
            while left:
                content = f.read(min(left, BATCH * WIDTH))
                if not content:
                    raise ValueError(f"{part.file} ends early")
                x = np.frombuffer(content, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + len(x))), pa.array(x)], ["pos", "x"])
                left, pos = left - len(content), pos + len(x)


@dataclass
class Part(WriterCommitMessage):
    task: int
    file: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        store, at = _store(self.path)
        context = TaskContext.get()
        file = f"{at}/_temporary/{context.partitionId():06d}-{context.taskAttemptId()}"
        store.create_dir(f"{at}/_temporary", recursive=True)
        with store.open_output_stream(file) as f:
            for batch in batches:
                x = batch.column("x").to_numpy(zero_copy_only=False)
                if len(x) and (x.min() < -(1 << 31) or x.max() >= 1 << 31):
                    raise ValueError("a number does not fit 32 bits")
                f.write(x.astype(np.int32).tobytes())
        return Part(context.partitionId(), file)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = _store(self.path)
        for old, _ in _parts(self.path) if self.overwrite else ():
            store.delete_file(old)
        for i, part in enumerate(sorted((m for m in messages if m), key=lambda m: m.task)):
            store.move(part.file, f"{at}/part-{i:06d}")
        self.abort(messages)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        if store.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary")


class Integers(DataSource):
    """spark.read.format("integers32").load(path): pos, x."""

    @classmethod
    def name(cls) -> str:
        return "integers32"

    def schema(self) -> str:
        return "pos long, x long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_integers(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """pos, x of an array: a file or a folder of parts, in ranges of at most `size` bytes."""
    spark.dataSource.register(Integers)
    return spark.read.format("integers32").option("range", str(size)).load(path)


def write_integers(array: DataFrame, path: str) -> None:
    """Writes (pos, x) as parts in the order of pos, which must run from 0 without gaps; replaces what is there."""
    array.sparkSession.dataSource.register(Integers)
    ordered = array.select("pos", "x").repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.write.format("integers32").mode("overwrite").save(path)
