"""python -m lattica --dataset NAME --model GCN: a forward pass over a graph on disk, timed."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from . import api
from .plans.models import MODELS


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lattica")
    p.add_argument("--dataset", required=True, help="name of the graph files")
    p.add_argument("--datadir", default=".", help="folder that holds them")
    p.add_argument("--format", default="text", choices=["text", "binary", "cached", "parquet"])
    p.add_argument("--reorder", help="path of a permutation file")
    p.add_argument("--model", default="GCN", choices=sorted(MODELS))
    p.add_argument("--feature-len", type=int, default=512)
    p.add_argument("--widths", default="128,64,32", help="widths of the layers after the features")
    p.add_argument("--outfea", type=int, help="width of the last layer, instead of that in --widths")
    p.add_argument("--nei", type=int, default=16, help="neighbours of an LSTM sequence")
    p.add_argument("--runs", type=int, default=1)
    p.add_argument("--out", help="write the result as Parquet")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges, vertices = api.load_graph(spark, f"{a.datadir}/{a.dataset}", a.format, a.reorder)
    widths = [a.feature_len, a.nei] if a.model == "sagelstm" else [a.feature_len, *map(int, a.widths.split(","))]
    if a.outfea and a.model != "sagelstm":
        widths[-1] = a.outfea
    layers = api.random_layers(a.model, widths)
    result = api.run(a.model, edges, api.features(vertices, a.feature_len), vertices, layers)
    for i in range(a.runs):
        began = time.perf_counter()
        result.write.format("noop").mode("overwrite").save()
        print(f"{a.dataset} {a.model} run {i} time {time.perf_counter() - began:.4f}")
    if a.out:
        result.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
