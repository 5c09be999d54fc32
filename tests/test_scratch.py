"""Tables between steps: read as long as they are there, and deleted together."""

from __future__ import annotations

from pathlib import Path

from lattica.sources.scratch import clear, scratch, written


def test_clear(spark):
    clear(spark)
    kept = scratch(spark, "kept")
    spark.range(3).write.parquet(kept)
    tables = [written(spark.range(5), "a"), written(spark.range(7), "b")]
    folders = [Path(f.removeprefix("file://")).parent for t in tables for f in t.inputFiles()[:1]]
    assert [t.count() for t in tables] == [5, 7] and all(f.is_dir() for f in folders)
    assert clear(spark) == 2 and not any(f.exists() for f in folders) and clear(spark) == 0
    assert spark.read.parquet(kept).count() == 3
