"""Graphs on disk in ranges of bytes: text of any line length, raw integers, commits, the cache on first read, the command line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import __main__ as command
from lattica import api
from lattica.sources import dumps, files

PTR, IDX = [0, 2, 3, 3, 5], [0, 1, 1, 0, 3]
COO = [(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 3, 0), (4, 3, 3)]


def coo(edges):
    return sorted((r.eid, r.dst, r.src) for r in edges.collect())


@pytest.mark.parametrize("text", ["0 2 3 3 5\n0 1 1 0 3\n", "0 2 3 3 5 \r\n 0  1 1 0 3", "\n0\t2 3 3 5\n0 1\t1 0 3\n\n", "0 2 3 3 5\n \n0 1 1 0 3"])
@pytest.mark.parametrize("size", ["4", "1000"])
def test_text_in_ranges(spark, tmp_path, text, size):
    (tmp_path / "g.graph").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert coo(files.read_csr_text(spark, f"{tmp_path}/g.graph")) == COO
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_long_line_is_many_tasks(spark, tmp_path):
    n = 40_000
    (tmp_path / "p.reorder").write_text(" ".join(str((i * 7) % n) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = spark.read.option("lineSep", " ").text(f"{tmp_path}/p.reorder")
        assert raw.rdd.getNumPartitions() > 8 and raw.agg(F.max(F.length("value"))).head()[0] <= 5
        got = files.read_permutation(spark, f"{tmp_path}/p.reorder").toPandas().sort_values("pos")
        assert (got.pos == np.arange(n)).all() and (got.v == np.arange(n) * 7 % n).all()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_integers_in_ranges_and_commits(spark, tmp_path):
    x = np.arange(10_007, dtype=np.int32)[::-1] - 5000
    x.tofile(tmp_path / "a.dump")
    source = dumps.read_integers(spark, f"{tmp_path}/a.dump", 1001)
    assert source.rdd.getNumPartitions() == -(-10_007 * 4 // 1000)
    got = source.toPandas().sort_values("pos")
    assert (got.x == x).all() and (got.pos == np.arange(len(x))).all()
    dumps.write_integers(source.repartition(5), f"{tmp_path}/b.dump")
    again = dumps.read_integers(spark, f"{tmp_path}/b.dump", 4000).toPandas().sort_values("pos")
    assert (again.x == x).all() and dumps.exists(f"{tmp_path}/b.dump") and not list((tmp_path / "b.dump").glob("_temporary*"))
    joined = b"".join(p.read_bytes() for p in sorted((tmp_path / "b.dump").glob("part-*")))
    assert joined == x.tobytes()  # the parts, one after the other, are the one file
    dumps.write_integers(source.limit(0), f"{tmp_path}/b.dump")
    assert dumps.read_integers(spark, f"{tmp_path}/b.dump").count() == 0
    (tmp_path / "odd.dump").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        dumps.read_integers(spark, f"{tmp_path}/odd.dump").count()
    with pytest.raises(Exception, match="32 bits"):
        dumps.write_integers(spark.createDataFrame([(0, 1 << 40)], "pos long, x long"), f"{tmp_path}/c.dump")
    assert not dumps.exists(f"{tmp_path}/c.dump")


def test_cache_on_first_read_and_missing_order(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert not dumps.exists("g.graph") and not dumps.exists(f"file:{tmp_path}/g.graph")
    (tmp_path / "g.config").write_text("4 5\n")
    (tmp_path / "g.graph").write_text("0 2 3 3 5\n0 1 1 0 3\n")
    assert dumps.exists("g.graph") and dumps.exists(f"file:{tmp_path}/g.graph")
    assert coo(api.load_graph(spark, f"{tmp_path}/g", "cached")[0]) == COO
    (tmp_path / "g.graph").unlink()
    assert coo(api.load_graph(spark, f"{tmp_path}/g", "cached", reorder=f"{tmp_path}/none")[0]) == COO
    assert coo(api.load_graph(spark, f"{tmp_path}/g", "binary")[0]) == COO


def test_text_written_in_ranges(spark, tmp_path):
    edges = spark.createDataFrame([(*c, 1.0) for c in COO], "eid long, dst long, src long, val double").repartition(3)
    files.write_csr_text(edges, spark.range(4).withColumnRenamed("id", "v"), f"{tmp_path}/out")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert [[int(w) for w in line.split()] for line in whole.split("\n")] == [PTR, IDX]
    assert coo(files.read_csr_text(spark, f"{tmp_path}/out")) == COO


@pytest.mark.parametrize("model", ["GCN", "GAT", "sagelstm", "GCN_nograph"])
def test_command_line(spark, tmp_path, model, capsys):
    (tmp_path / "g.config").write_text("4 5\n")
    (tmp_path / "g.graph").write_text("0 2 3 3 5\n0 1 1 0 3\n")
    (tmp_path / "g.order").write_text("2 0 3 1")
    command.main(["--dataset", "g", "--datadir", str(tmp_path), "--model", model, "--feature-len", "8", "--widths", "6,4", "--outfea", "3", "--nei", "2", "--reorder", f"{tmp_path}/g.order", "--format", "cached", "--out", f"{tmp_path}/y"])
    assert f"g {model} run 0 time" in capsys.readouterr().out
    rows = spark.read.parquet(f"{tmp_path}/y").collect()
    assert {len(r.feat) for r in rows} == {8 if model == "sagelstm" else 3} and len(rows) == (2 if model == "sagelstm" else 4)
