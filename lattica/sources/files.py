"""CSR graphs as text and as raw integers, permutations, configurations and result logs, on any file system Spark reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import exclusive_prefix, number_rows
from . import dumps
from .scratch import written


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """num_v, num_e of a .config file."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path, wholetext=True).select(F.get(words, F.lit(0)).cast("long").alias("num_v"), F.get(words, F.lit(1)).cast("long").alias("num_e"))


def numbers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words(pos, x), breaks(at)) of a text of integers: each with its place among all, and the places where a line ends.

    The text may be one file or a folder of parts, and its lines of any length: Spark's text source cuts a file into ranges
    of bytes and ends a record at each blank, so a line of gigabytes is read by many tasks and no row holds more than a
    word. Places come from counts per range (see `exclusive_prefix`).
    """
    raw = spark.read.option("lineSep", " ").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = F.split("value", r"\r?\n")
    count = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    counted = written(raw.where(F.trim("value") != "").select("*", count(F.col("value")).alias("n")), "words")
    placed = exclusive_prefix(counted, ["file", "block", "row"], "n", "at")
    words = placed.select("at", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("k", "x"))
    ends = placed.where(F.size(lines) > 1).select((F.col("at") + count(F.get(lines, F.lit(0)))).alias("at"))
    return words.select((F.col("at") + F.col("k")).alias("pos"), F.col("x").cast("long").alias("x")), ends


def read_csr_text(spark: SparkSession, path: str) -> DataFrame:
    """edges(eid, dst, src, val) of a .graph file: a line of row pointers, a line of neighbours; val is 1."""
    words, ends = numbers(spark, path)
    first = ends.where("at > 0").agg(F.min("at")).head()[0]
    if first is None:
        raise ValueError(f"{path} has no second line")
    return csr_to_edges(words.where(F.col("pos") < first), words.where(F.col("pos") >= first).select((F.col("pos") - first).alias("pos"), "x"))


def read_csr_binary(spark: SparkSession, pointers: str, neighbours: str) -> DataFrame:
    """edges of a .ptrdump and an .edgedump, files or folders of parts, read in ranges of bytes."""
    return csr_to_edges(dumps.read_integers(spark, pointers), dumps.read_integers(spark, neighbours))


def write_csr_binary(edges: DataFrame, vertices: DataFrame, pointers: str, neighbours: str) -> None:
    """The same pair of arrays, each a folder of parts that take their place when all are written."""
    dumps.write_integers(edges_to_ptr(edges, vertices), pointers)
    dumps.write_integers(edges.select(F.col("eid").alias("pos"), F.col("src").alias("x")), neighbours)


def csr_to_edges(ptr: DataFrame, idx: DataFrame) -> DataFrame:
    """CSR arrays (pos, x) to edges. Pointers become begin and end of each row and rows are spelled out by sequence."""
    following = ptr.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("end"))
    rows = ptr.withColumnRenamed("x", "begin").join(following, "pos").where("end > begin")
    cells = rows.select(F.col("pos").alias("dst"), F.explode(F.sequence("begin", F.col("end") - 1)).alias("eid"))
    return cells.join(idx.select(F.col("pos").alias("eid"), F.col("x").alias("src")), "eid").select("eid", "dst", "src", F.lit(1.0).alias("val"))


def edges_to_ptr(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """pos, x: row pointers, the last of which is the number of edges; vertices are 0 .. n - 1."""
    counts = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("deg"))
    sized = vertices.select("v").join(counts, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))
    begins = exclusive_prefix(sized, "v", "deg", "x")
    last = sized.agg(F.count("*").alias("pos"), F.coalesce(F.sum("deg"), F.lit(0)).alias("x"))
    return begins.select(F.col("v").alias("pos"), "x").unionByName(last.select("pos", "x"))


def write_csr_text(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """A folder of parts which, one after the other, are the two lines that read_csr_text takes: a word is a row, ranges of
    places are parts, and the last pointer carries the end of its line."""
    ptr = edges_to_ptr(edges, vertices)
    last = vertices.count()
    end = F.when(F.col("pos") == last, F.lit("\n")).otherwise(F.lit(""))
    words = ptr.select(F.lit(0).alias("line"), "pos", F.concat(F.col("x").cast("string"), end).alias("value"))
    words = words.unionByName(edges.select(F.lit(1).alias("line"), F.col("eid").alias("pos"), F.col("src").cast("string").alias("value")))
    words.repartitionByRange("line", "pos").sortWithinPartitions("line", "pos").select("value").write.option("lineSep", " ").text(path)


def write_cache(edges: DataFrame, path: str) -> DataFrame:
    """The graph as Parquet, ordered by receiver inside its files, and read back: the cache of a parsed graph."""
    edges.repartitionByRange("dst").sortWithinPartitions("dst", "eid").write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)


def edge_index(edges: DataFrame) -> DataFrame:
    """pos, src, dst: edges bucketed by neighbour, each bucket in row order."""
    return number_rows(edges, ["src", "eid"], "pos").select("pos", "src", "dst")


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """order(pos, v) of a .reorder file, on one line or several."""
    return numbers(spark, path)[0].select("pos", F.col("x").alias("v"))


def write_permutation(order: DataFrame, path: str) -> None:
    """Ids by position, one a line; files are ranges of positions in their order."""
    order.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("v").cast("string").alias("value")).write.text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """A number a line, appended."""
    rows.select(F.format_string("%f", F.col(rows.columns[0])).alias("value")).write.mode("append").text(path)


def peek(df: DataFrame, n: int = 10) -> list:
    """The first rows, for people to look at."""
    return df.limit(n).collect()


def random_features(vertices: DataFrame, width: int, seed: int = 123) -> DataFrame:
    """features(v, feat) of standard normal numbers that depend on vertex, place and seed alone.

    A counter-based generator: the digest of "seed:vertex:place" gives two numbers of 32 bits, and these a normal one by
    their logarithm and angle. Any engine that has the digest has the same numbers, in any order and partitioning.
    """
    def normal(k: int) -> Column:
        digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col("v").cast("string"), F.lit(f":{k}")), "UTF-8"))
        unit = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
        return F.sqrt(F.lit(-2.0) * F.ln(unit(1))) * F.cos(F.lit(2 * np.pi) * unit(9))

    return vertices.select("v", F.array(*[normal(k) for k in range(width)]).alias("feat"))
