"""Approximate nearest neighbours: a hierarchical k-means tree, read best bin first to a calibrated number of leaves.

The tree is fitted to a bounded sample; every row is dealt to a leaf. For some queries the true neighbours are found by
brute force over all rows; the number of leaves that holds the wanted share of them is then visited for every query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package

#: Rows that the tree is fitted to; rows aimed at in a leaf; children of a node; leaves at most.
SAMPLE, LEAF_ROWS, BRANCHES, MOST_LEAVES = 20_000, 200, 8, 4096
#: Queries that calibrate, and the share of their true neighbours that must be found.
CALIBRATE, RECALL = 64, 0.97
#: Bytes of the sample's vectors at most, which long vectors reach before SAMPLE rows.
SAMPLE_BYTES = 64_000_000
#: The commonest lengths of vectors, which have an index each; rows of other lengths are few and are compared in blocks.
MOST_LENGTHS = 32
#: Rows of a group of leaves, which a task holds at once, and queries whose best rows it holds before it passes them on.
BLOCK, HELD = 2048, 50_000
#: Groups of leaves that one Arrow batch of a query's rows names.
PASSED = 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """centres[i] is node i's; children[i] its nodes; leaf[i] its leaf number or -1."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, points: np.ndarray, share: float, rng: np.random.Generator) -> int:
        at = len(self.centres)
        self.centres.append(points.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        groups = _split(points, rng) if len(points) > share else []
        if len(groups) < 2:
            self.leaf[at] = self.leaves
            self.leaves += 1
        for g in groups:
            self.children[at].append(self.add(points[g], share, rng))
        return at

    def finish(self) -> Tree:
        self.matrix = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]
        return self

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: from the root, always the child with the nearest centre."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = _distances(points[rows], self.matrix[node]).argmin(1)
            stack += [(c, rows[nearest == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, point: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the queue holds passed-by nodes by the distance of their centres."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:
                d = ((self.matrix[node] - point) ** 2).sum(1)
                best = int(d.argmin())
                for i, c in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), c))
                node = self.children[node][best]
            yield self.leaf[node]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def _split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    distinct = np.unique(points, axis=0)
    k = min(BRANCHES, len(distinct))
    if k < 2:
        return []
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(10):
        owner = _distances(points, centres).argmin(1)
        centres = np.stack([points[owner == i].mean(0) if (owner == i).any() else centres[i] for i in range(k)])
    owner = _distances(points, centres).argmin(1)
    return [g for i in range(k) if len(g := np.flatnonzero(owner == i))]


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest(block_ids: np.ndarray, block: np.ndarray, query: int, point: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((block - point) ** 2).sum(1))
    rows = np.flatnonzero(block_ids != query)
    return _first(block_ids[rows], d[rows], k)


def _first(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids, each with its least distance."""
    rows = np.lexsort((ids, d))
    top = rows[:k]
    if len(np.unique(ids[top])) < len(top):
        top = rows[np.sort(np.unique(ids[rows], return_index=True)[1])[:k]]
    return ids[top], d[top]


def _better(one: tuple[np.ndarray, np.ndarray] | None, two: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both."""
    return two if one is None else _first(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), k)


def _passed_on(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    queries = np.repeat(np.fromiter(best, np.int64), [len(x) for x, _ in best.values()])
    return pa.RecordBatch.from_arrays([pa.array(queries), *[pa.array(np.concatenate([x[c] for x in best.values()])) for c in range(2)]], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose key is divisible by `every`.

    Score is the Euclidean distance in double precision; ties go to the smaller key; a query never finds its own key.
    Unusable vectors and null keys take no part; an empty table has no rows. A query finds vectors of its own length
    only, as others have no distance to it; each of the MOST_LENGTHS commonest lengths has its own index, and all others
    (each at most one row in MOST_LENGTHS) are compared with every query of their length, in blocks.
    Repeated rows count once. Rows that share a key and differ are one thing with several vectors: two keys are as far
    apart as their nearest vectors, and each key is found once. Of equal vectors only the k + 1 smallest keys can ever
    be found, so the index holds no more of them (a limit pushed below the shuffle) and a common vector is no hot leaf.
    Leaves share groups of some BLOCK rows, and larger ones are cut into them; queries stream past a group, each with the
    list of leaves that it visits there, so that its vector is sent once a group and never a batch of all visits.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = [r["size"] for r in rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(MOST_LENGTHS + 1).collect()]
    found = [_nearest_of_length(rows.where(F.size("v") == n), n, k, every, seed) for n in lengths[:MOST_LENGTHS]]
    if len(lengths) > MOST_LENGTHS:
        found.append(_nearest_of_others(rows.where(~F.size("v").isin(lengths[:MOST_LENGTHS])), k, every))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hits = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_of_others(rows: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, vec_id, score: the best k rows of each block of a query's length, by brute force."""
    rows = materialise(rows.dropDuplicates(["id", "v"]).withColumn("size", F.size("v")), "other-lengths")
    blocks = rows.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = rows.join(blocks, "size").select("size", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("vec_id"), "v")
    asked = rows.where(F.col("id") % every == 0).join(blocks, "size").select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("query_id"), F.col("v").alias("point"))
    squares = F.zip_with("v", "point", lambda x, y: (x - y) * (x - y))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    met = asked.join(held, ["size", "block"]).where("query_id != vec_id").select("query_id", "block", "vec_id", score.alias("score"))
    near = met.groupBy("query_id", "block", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id", "block").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score")


def _nearest_of_length(rows: DataFrame, length: int, k: int, every: int, seed: int) -> DataFrame:
    """query_id, vec_id, score: the best k rows of each block that a query visits."""
    spark = rows.sparkSession
    alike = Window.partitionBy("v").orderBy("id")
    index = materialise(rows.dropDuplicates(["id", "v"]).withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    queries = rows.where(F.col("id") % every == 0)
    total = index.count()

    wanted, bits = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length))), 1 << 31
    hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bits))
    share = int(min(1.0, (wanted + 6 * wanted**0.5) / max(1, total)) * bits)  # tasks drop what can't be among the first
    sample = np.array([r.v for r in index.where(hashed < share).orderBy(hashed, "id").limit(wanted).collect()])
    leaves = max(1, min(MOST_LEAVES, total // LEAF_ROWS))
    tree = Tree()
    tree.add(sample, max(1, len(sample) / leaves), np.random.default_rng(seed))
    tree.finish()
    sent = spark.sparkContext.broadcast(tree)  # SAMPLE, SAMPLE_BYTES and MOST_LEAVES bound it

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent.value.assign(_matrix(batch.column(1))))], ["id", "v", "leaf"])

    leafed = materialise(index.mapInArrow(dealt, "id long, v array<double>, leaf long"), "leaves")
    counts = np.zeros(tree.leaves, np.int64)
    for r in leafed.groupBy("leaf").count().collect():  # a row per leaf
        counts[r.leaf] = r["count"]
    first, blocks = _grouped(counts)

    visits = _calibrated(leafed, queries, tree, k, seed)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group = first[leaf] + (mixed % blocks[leaf].astype(np.uint64)).astype(np.int64)
            none = pa.array([None] * len(ids), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.zeros(len(ids), np.int64)), pa.array(leaf), pa.array(ids), batch.column("v"), none], names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            ids, points, v = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(1)
            for i in range(len(ids)):
                leaves, rows_seen = [], 0
                for leaf in own.visit(points[i]):
                    if counts[leaf]:
                        leaves.append(leaf)
                        rows_seen += counts[leaf]
                    if len(leaves) >= visits and rows_seen > k:
                        break
                wanted: dict[int, list[int]] = {}
                for leaf in sorted(leaves):
                    for group in range(first[leaf], first[leaf] + blocks[leaf]):
                        wanted.setdefault(group, []).append(leaf)
                groups = list(wanted)
                for at in range(0, len(groups), PASSED):  # a query goes to many groups: its rows are passed on in parts
                    part, n = groups[at : at + PASSED], min(PASSED, len(groups) - at)
                    one, same = np.ones(n, np.int64), v.take(pa.array(np.full(n, i)))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(one), pa.array(one), pa.array(np.full(n, ids[i])), same, pa.array([wanted[g] for g in part], pa.list_(pa.int64()))], names)

    names = ["group", "kind", "leaf", "id", "v", "leaves"]
    schema = "group long, kind long, leaf long, id long, v array<double>, leaves array<long>"
    spread = queries.repartition(2 * spark.sparkContext.defaultParallelism, "id")
    both = leafed.mapInArrow(stored, schema).unionByName(spread.mapInArrow(asked, schema)).repartition("group").sortWithinPartitions("group", "kind", "leaf")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("group", "kind")], 1)
            ids, points, leaf, leaves = batch.column("id").to_numpy(), _matrix(batch.column("v")), batch.column("leaf").to_numpy(), batch.column("leaves")
            edges = np.concatenate([[0], np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1, [len(ids)]])
            for a, b in zip(edges, edges[1:], strict=False):
                if place[a][0] != at:
                    at, held, block = place[a][0], [], None
                if place[a][1] == 0:
                    held.append((ids[a:b], points[a:b], leaf[a:b]))
                    continue
                if block is None:
                    block = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0, np.int64), np.empty((0, points.shape[1])), np.empty(0, np.int64)]
                    held = []
                for i in range(a, b):
                    wanted = leaves[i].values.to_numpy()
                    ends = np.searchsorted(block[2], wanted, "left"), np.searchsorted(block[2], wanted, "right")
                    rows = np.concatenate([np.arange(x, y) for x, y in zip(*ends, strict=True)])
                    best[ids[i]] = _better(best.get(ids[i]), _nearest(block[0][rows], block[1][rows], ids[i], points[i], k), k)
            if len(best) >= HELD:
                yield _passed_on(best)
                best = {}
        if best:
            yield _passed_on(best)

    return both.mapInArrow(matched, "query_id long, vec_id long, score double")


def _grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each leaf, and how many it has: leaves share a group of up to BLOCK rows, and one with more rows
    has groups of its own, over which its rows are dealt. A query's vector is sent to groups, not to leaves."""
    blocks = np.maximum(1, -(-counts // BLOCK))
    first, group, room = np.zeros(len(counts), np.int64), -1, 0
    for leaf, n in enumerate(counts):
        if blocks[leaf] > 1 or n > room or group < 0:
            group, room = group + 1, BLOCK
        first[leaf], room = group, room - n
        if blocks[leaf] > 1:
            group, room = group + blocks[leaf] - 1, 0
    return first, blocks


def exact(vectors: DataFrame, points: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, vec_id, score, leaf or null: the true k nearest of a few given points, by brute force in blocks."""
    ids, at = np.array([i for i, _ in points]), np.array([p for _, p in points])
    extra = "leaf" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, own = batch.column(0).to_numpy(), _matrix(batch.column(1))
            leaf = batch.column(2).to_numpy() if extra else np.full(len(mine), -1)
            for q in range(len(ids)):
                d = np.sqrt(((own - at[q]) ** 2).sum(1))
                n, e, f = (np.concatenate(x) for x in zip(best[q], (mine, d, leaf), strict=True))
                rows = np.flatnonzero(n != ids[q])
                rows = rows[np.lexsort((n[rows], e[rows]))[:k]]
                best[q] = (n[rows], e[rows], f[rows])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(ids, [len(b[0]) for b in best])), *[pa.array(np.concatenate([b[c] for b in best])) for c in range(3)]
        ], ["query_id", "vec_id", "score", "leaf"])

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = vectors.select("id", "v", *["leaf"] * extra).mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrated(leafed: DataFrame, queries: DataFrame, tree: Tree, k: int, seed: int) -> int:
    """How many leaves to visit so that RECALL of the true neighbours of the calibrating queries is among them."""
    chosen = [(r.id, list(r.v)) for r in queries.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(CALIBRATE).collect()]
    if not chosen:
        return 1
    truth: dict[int, list[int]] = {}
    for r in exact(leafed, chosen, k).collect():  # CALIBRATE x k rows
        truth.setdefault(r.query_id, []).append(r.leaf)
    places = []
    for i, point in chosen:
        rank = {leaf: n for n, leaf in enumerate(tree.visit(np.array(point)))}
        places += [rank[leaf] + 1 for leaf in truth.get(i, [])]
    return int(np.quantile(places, RECALL, method="higher")) if places else 1
