"""Sizes of named graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Published sizes of the benchmark graphs (None: not recorded).
DATASETS = [
    ("arxiv", 169343, 1166243),
    ("collab", None, 2358104),
    ("citation", None, 30387995),
    ("ddi", None, 2135822),
    ("protein", 132534, 79122504),
    ("ppa", None, 42463862),
    ("reddit", 232965, 114615891),
    ("products", 2449029, 123718280),
]


def datasets(spark: SparkSession) -> DataFrame:
    """name, num_v, num_e of the benchmark graphs."""
    return spark.createDataFrame(DATASETS, "name string, num_v long, num_e long")


def read_sizes(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """name, size, collection of a file with a `name size` or `name: size` pair a line: catalogues of any length."""
    parts = F.split(F.trim(F.regexp_replace("value", r"[:=,'\"\s]+", " ")), " ")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("long").alias("size"))
    return rows.where("size is not null").withColumn("collection", F.lit(collection))


def lookup(named: DataFrame, catalogue: DataFrame, path: str = "path") -> DataFrame:
    """Rows with the catalogue's columns for the last element of their path."""
    from ..operators.metrics import last_element

    return named.withColumn("name", last_element(F.col(path))).join(F.broadcast(catalogue) if catalogue.isLocal() else catalogue, "name", "left")
