"""A query per operator, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from . import fixtures as fx
from .functions import gflops, leaky_relu, logistic, relu, tanh
from .operators import aggregate, attention, dense, edge_ops, lstm, metrics, order, reorder, sample, schedule, similar, validate
from .operators.schedule import Schedule
from .plans import models
from .plans.rewrite import Linear, stack
from .sources import catalog, files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(body: str, *parts: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(parts) + "\n" + body


def _long(features: DataFrame, out: str = "y", digits: int | None = None) -> DataFrame:
    x = F.col("x") if digits is None else F.round("x", digits) + F.lit(0.0)
    return aggregate.to_long(features).select("v", "k", x.alias(out))


# --- the graph in SQL -----------------------------------------------------------------------------------------------

N = "n AS (SELECT count(*) AS n FROM embeddings)"
V = "vs AS (SELECT vec_id AS v FROM embeddings)"
E = f"""{N}, e AS (SELECT row_number() OVER (ORDER BY dst, src) - 1 AS eid, dst, src, count(*)::DOUBLE AS val FROM (
  SELECT l_partkey % n - (l_partkey % n % {fx.GAP} = 3)::BIGINT AS dst, (l_orderkey * 7 + l_suppkey) % n AS src FROM lineitem, n) t GROUP BY dst, src)"""


def _x(width: int = fx.WIDTH, name: str = "x") -> str:
    return f"{name} AS (SELECT * FROM (SELECT vec_id AS v, unnest(range(len(embedding)))::BIGINT AS k, round(unnest(embedding)::DOUBLE * 1024) / 1024 + 0.0 AS x FROM embeddings) t WHERE k < {width})"


def _tiled(width: int, name: str = "x") -> str:
    return f"{name} AS (SELECT v, k + {fx.WIDTH} * t AS k, x FROM (SELECT vec_id AS v, unnest(range(len(embedding)))::BIGINT AS k, round(unnest(embedding)::DOUBLE * 64) / 64 + 0.0 AS x FROM embeddings) u, range({-(-width // fx.WIDTH)}) r(t) WHERE k + {fx.WIDTH} * t < {width})"


def _w(inputs: int, outputs: int, name: str = "w", formula: str = "((i * 31 + o * 17) % 23 - 11) / 16.0e0") -> str:
    return f"{name} AS (SELECT i, o, {formula} AS w FROM range({inputs}) a(i), range({outputs}) b(o))"


SMALL = "((i * 31 + o * 17) % 3 - 1) / 2.0e0"


def _attn(of: str = "x", name: str = "attn") -> str:
    return f"{name} AS (SELECT v, sum(x * (((k * 7) % 5 - 2) / 16.0e0)) AS a_dst, sum(x * (((k * 3) % 7 - 3) / 16.0e0)) AS a_src FROM {of} GROUP BY v)"


def _sum(of: str, out: str, value: str = "val * x", edges: str = "e") -> str:
    """Neighbour sums of `of` with zeros, as (v, k, x)."""
    return f"{out}_s AS (SELECT dst AS v, k, sum({value}) AS y FROM {edges} JOIN {of} ON {of}.v = {edges}.src GROUP BY dst, k), {out} AS (SELECT {of}.v, {of}.k, coalesce({out}_s.y, 0.0) AS x FROM {of} LEFT JOIN {out}_s USING (v, k))"


def _mm(of: str, w: str, out: str, relu_: bool = False) -> str:
    y = "sum(x * w)"
    return f"{out} AS (SELECT v, o AS k, {f'greatest({y}, 0.0)' if relu_ else y} AS x FROM {of} JOIN {w} ON k = i GROUP BY v, o)"


def _relu(of: str, out: str) -> str:
    return f"{out} AS (SELECT v, k, greatest(x, 0.0) AS x FROM {of})"


def _scores(slope: float | None = 0.2, of: str = "attn", out: str = "sc", edges: str = "e") -> str:
    z = "d.a_dst + s.a_src"
    z = f"exp(greatest({z}, {slope}::DOUBLE * ({z})))" if slope is not None else z
    return f"{out} AS (SELECT eid, dst, src, {z} AS z FROM {edges} JOIN {of} d ON d.v = dst JOIN {of} s ON s.v = src)"


def _gat(of: str, sc: str, out: str) -> str:
    return f"{out}_s AS (SELECT dst AS v, k, sum(z * x) / sum(z) AS y FROM {sc} JOIN {of} ON {of}.v = src GROUP BY dst, k), {out} AS (SELECT {of}.v, {of}.k, coalesce({out}_s.y, 0.0) AS x FROM {of} LEFT JOIN {out}_s USING (v, k))"


OUT = "SELECT v, k, x AS y FROM {}"
OUT6 = "SELECT v, k, round(x, 6) + 0.0 AS y FROM {}"

# --- sources and layouts --------------------------------------------------------------------------------------------


@query(_with("SELECT (SELECT n FROM n) AS num_v, count(*) AS num_e FROM e", E))
def load_config(spark, d):
    path = fx.scratch(spark, "config")
    line = F.concat_ws(" ", F.lit(fx.size(spark, d)), F.count("*"))
    fx.edges(spark, d).agg(line.alias("value")).coalesce(1).write.text(path)
    return files.read_config(spark, path)


@query(_with("SELECT eid, dst, src, 1.0e0 AS val FROM e", E))
def load_csr_text(spark, d):
    path = fx.scratch(spark, "graph")
    files.write_csr_text(fx.edges(spark, d), fx.vertices(spark, d), path)
    return files.read_csr_text(spark, path)


@query(_with("SELECT eid, dst, src, 1.0e0 AS val FROM e", E))
def load_csr_binary(spark, d):
    """The graph as raw integers: the first load parses the text and writes them, the second reads them."""
    path, edges = fx.scratch(spark, "raw"), fx.edges(spark, d)
    edges.agg(F.concat_ws(" ", F.lit(fx.size(spark, d)), F.count("*")).alias("value")).coalesce(1).write.text(f"{path}.config")
    files.write_csr_text(edges, fx.vertices(spark, d), f"{path}.graph")
    api.load_graph(spark, path, "cached")
    return api.load_graph(spark, path, "cached")[0]


@query(_with("SELECT eid, dst, src, val FROM e", E))
def graph_cache(spark, d):
    return files.write_cache(fx.edges(spark, d), fx.scratch(spark, "cache")).select("eid", "dst", "src", "val")


CSR_PTR = _with(
    "SELECT v AS pos, (coalesce(sum(deg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x FROM g UNION ALL SELECT count(*), sum(deg)::BIGINT FROM g",
    E, V, "g AS (SELECT v, count(dst) AS deg FROM vs LEFT JOIN e ON dst = v GROUP BY v)",
)


@query(CSR_PTR)
def csr_ptr(spark, d):
    return files.edges_to_ptr(fx.edges(spark, d), fx.vertices(spark, d))


@query(_with("SELECT src, dst, eid FROM e", E))
def csr_to_coo(spark, d):
    edges = fx.edges(spark, d)
    ptr = files.edges_to_ptr(edges, fx.vertices(spark, d))
    return files.csr_to_edges(ptr, edges.select(F.col("eid").alias("pos"), F.col("src").alias("x"))).select("src", "dst", "eid")


@query(_with("SELECT row_number() OVER (ORDER BY src, eid) - 1 AS pos, src, dst FROM e", E))
def edge_index(spark, d):
    return files.edge_index(fx.edges(spark, d))


PERMUTATION = _with("SELECT (v * 7 + 3) % n AS pos, v FROM vs, n", N, V)


@query(PERMUTATION)
def load_permutation(spark, d):
    path = fx.scratch(spark, "reorder")
    files.write_permutation(fx.permutation(spark, d), path)
    return files.read_permutation(spark, path)


@query(_with("SELECT pos, v AS inverse_v, v, pos AS inverse_pos FROM p", "p AS (" + PERMUTATION + ")"))
def inverse_permutation(spark, d):
    p = fx.permutation(spark, d)
    return p.select("pos", F.col("v").alias("inverse_v"), "v", F.col("pos").alias("inverse_pos"))


@query(_with(
    "SELECT v, k, round(sqrt(-2.0e0 * ln(u1)) * cos(2 * pi() * u2), 9) + 0.0 AS y FROM u", V,
    "h AS (SELECT v, k::BIGINT AS k, md5('123:' || v || ':' || k) AS h FROM vs, range(16) r(k))",
    "u AS (SELECT v, k, (('0x' || left(h, 8))::BIGINT + 0.5e0) / 4294967296.0e0 AS u1, (('0x' || substr(h, 9, 8))::BIGINT + 0.5e0) / 4294967296.0e0 AS u2 FROM h)",
))
def random_features(spark, d):
    return _long(files.random_features(fx.vertices(spark, d), 16), digits=9)


@query(_with("SELECT row_number() OVER (ORDER BY v) - 1 AS row, v, count(dst) AS deg FROM vs LEFT JOIN e ON dst = v GROUP BY v", E, V))
def full_graph(spark, d):
    return sample.full_graph(fx.edges(spark, d), fx.vertices(spark, d))[0].select("row", "v", "deg")


# --- gathers, edge expressions, filters -----------------------------------------------------------------------------


@query(_with("SELECT eid, k, x FROM e JOIN x ON x.v = src", E, _x()))
def gather(spark, d):
    return aggregate.gather(fx.edges(spark, d), fx.features(spark, d)).select("eid", F.posexplode("feat").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


@query(_with("SELECT dst, step, k, x FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY eid) - 1 AS step FROM e) s JOIN x ON x.v = src", E, _x()))
def gather_steps(spark, d):
    return aggregate.gather_steps(fx.edges(spark, d), fx.features(spark, d)).select("dst", "step", F.posexplode("feat").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


def _pair(spark, d):
    a = fx.attention(fx.WIDTH)
    return attention.attention_pair(fx.features(spark, d), list(a[:, 0]), list(a[:, 1]))


@query(_with("SELECT eid, dst, src, z FROM sc", E, _x(), _attn(), _scores(None)))
def edge_score(spark, d):
    return attention.edge_scores(fx.edges(spark, d), _pair(spark, d)).select("eid", "dst", "src", "z")


@query(_with("SELECT eid, round(val / sum(val) OVER (PARTITION BY dst), 6) + 0.0 AS p FROM e", E))
def edge_divide(spark, d):
    edges = fx.edges(spark, d)
    out = attention.divide_by_dst(edges, attention.edge_sums(edges, "val"), "val")
    return out.select("eid", (F.round("p", 6) + F.lit(0.0)).alias("p"))


@query(_with("SELECT x.v, x.k, CASE WHEN s <> 0 THEN round(x / s, 6) + 0.0 ELSE x END AS y FROM x JOIN (SELECT v, count(dst)::DOUBLE AS s FROM vs LEFT JOIN e ON dst = v GROUP BY v) t ON t.v = x.v", E, V, _x()))
def scale_rows(spark, d):
    deg = aggregate.degrees(fx.edges(spark, d), fx.vertices(spark, d)).select("v", F.col("deg").cast("double").alias("s"))
    rows = aggregate.to_long(attention.scale_rows(fx.features(spark, d), deg)).join(deg, "v")
    return rows.select("v", "k", F.when(F.col("s") != 0, F.round("x", 6) + F.lit(0.0)).otherwise(F.col("x")).alias("y"))


@query(_with("SELECT v, k, greatest(x, 0.25e0 * x) + 0.0 AS leaky, greatest(x, 0.0) + 0.0 AS relu, round(exp(x), 6) + 0.0 AS e, round(1 / (1 + exp(-x)), 6) + 0.0 AS logistic, round(tanh(x), 6) + 0.0 AS tanh FROM x", _x()))
def activations(spark, d):
    x, six = F.col("x"), lambda c: F.round(c, 6) + F.lit(0.0)
    rows = aggregate.to_long(fx.features(spark, d))
    return rows.select("v", "k", (leaky_relu(x, 0.25) + F.lit(0.0)).alias("leaky"), (relu(x) + F.lit(0.0)).alias("relu"), six(F.exp(x)).alias("e"), six(logistic(x)).alias("logistic"), six(tanh(x)).alias("tanh"))


@query(_with("SELECT eid, k, val * x AS m FROM e JOIN x ON x.v = src", E, _x()))
def edge_message(spark, d):
    rows = aggregate.gather(fx.edges(spark, d), fx.features(spark, d))
    return rows.select("eid", F.posexplode(F.transform("feat", lambda x: x * F.col("val"))).alias("k", "m")).withColumn("k", F.col("k").cast("long"))


@query(_with("SELECT eid, dst, src, CASE WHEN eid % 2 = 0 THEN eid / 4.0e0 ELSE val END AS val FROM e", E))
def update_values(spark, d):
    edges = fx.edges(spark, d)
    fresh = edges.where("eid % 2 = 0").select("eid", (F.col("eid") / 4.0).alias("val"))
    return aggregate.update_values(edges, fresh).select("eid", "dst", "src", "val")


@query(_with("SELECT eid, dst, src FROM e, n WHERE src >= n // 4 AND src < n // 2", E))
def range_filter(spark, d):
    n = fx.size(spark, d)
    return fx.edges(spark, d).where((F.col("src") >= n // 4) & (F.col("src") < n // 2)).select("eid", "dst", "src")


@query(_with("SELECT row_number() OVER (ORDER BY v) - 1 AS row, v FROM vs WHERE v % 3 = 0", V))
def active_compact(spark, d):
    return order.number_rows(fx.vertices(spark, d).where("v % 3 = 0"), "v", "row").select("row", "v")


@query(_with("SELECT v FROM vs WHERE v NOT IN (SELECT dst FROM e)", E, V))
def empty_rows(spark, d):
    return fx.vertices(spark, d).join(fx.plain_edges(spark, d).select(F.col("dst").alias("v")), "v", "left_anti")


@query(_with("SELECT eid, dst, src FROM e WHERE dst = src", E))
def self_loops(spark, d):
    return fx.edges(spark, d).where("dst = src").select("eid", "dst", "src")


@query(_with("SELECT DISTINCT src AS v FROM e WHERE dst IN (SELECT v FROM vs WHERE v % 50 = 0)", E, V))
def frontier_neighbours(spark, d):
    active = fx.vertices(spark, d).where("v % 50 = 0").withColumnRenamed("v", "dst")
    return fx.plain_edges(spark, d).join(active, "dst", "left_semi").select(F.col("src").alias("v")).distinct()


# --- aggregations ---------------------------------------------------------------------------------------------------


@query(_with(OUT.format("y"), E, _x(), _sum("x", "y")))
def spmm_weighted(spark, d):
    return _long(aggregate.spmm(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH))


def _tasked(spark, d, kind=Schedule.NEIGHBOR_GROUPING, parts=4):
    return schedule.tasked(fx.edges(spark, d), kind, fx.size(spark, d), parts, 32)


@query(_SQL["spmm_weighted"])
def spmm_grouped(spark, d):
    return _long(aggregate.spmm_grouped(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH))


@query(_SQL["spmm_weighted"])
def spmm_locality(spark, d):
    return _long(aggregate.spmm_grouped(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH, parts=4))


@query(_SQL["spmm_weighted"])
def spmm_edgewise(spark, d):
    coo = fx.edges(spark, d).select("src", "dst", "val")
    terms = aggregate.gather(coo, fx.features(spark, d)).select(F.col("dst").alias("v"), F.transform("feat", lambda x: x * F.col("val")).alias("feat"))
    return _long(aggregate.zero_fill(fx.vertices(spark, d), aggregate.sum_vectors(terms, ["v"], F.col("feat"), fx.WIDTH), fx.WIDTH))


@query(_with(OUT.format("y"), E, "r AS (SELECT e.* FROM e, n WHERE src >= n // 4 AND src < n // 2)", _x(), _sum("x", "y", edges="r")))
def spmm_range(spark, d):
    n = fx.size(spark, d)
    return _long(aggregate.spmm_ranges(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH, n // 4, n // 2))


@query(_with(OUT.format("y"), E, _x(), _sum("x", "y", "x")))
def spmm_unweighted(spark, d):
    return _long(aggregate.spmm(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH, weighted=False))


THEN_DENSE = _with(OUT.format("h"), E, _x(), _sum("x", "y"), _w(fx.WIDTH, 32), _mm("y", "w", "h"))


@query(THEN_DENSE)
def spmm_then_dense(spark, d):
    return _long(Linear(fx.weights(fx.WIDTH, 32), True).apply(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), dense_first=False))


@query(THEN_DENSE)
def spmm_dense_fused(spark, d):
    return _long(Linear(fx.weights(fx.WIDTH, 32), True).apply(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d)))


@query(_with("SELECT src, sum(val) AS total FROM e GROUP BY src", E))
def scatter_add(spark, d):
    return aggregate.scatter_sum(fx.plain_edges(spark, d), "src", "val")


@query(_with("SELECT dst AS v, sum(val) AS s FROM e GROUP BY dst", E))
def edge_sum(spark, d):
    return attention.edge_sums(fx.plain_edges(spark, d), "val")


@query(_with("SELECT eid, round(z / sum(z) OVER (PARTITION BY dst), 6) + 0.0 AS p FROM sc", E, _x(), _attn(), _scores()))
def edge_softmax(spark, d):
    return attention.edge_softmax(fx.edges(spark, d), _pair(spark, d)).select("eid", (F.round("p", 6) + F.lit(0.0)).alias("p"))


@query(_SQL["edge_softmax"])
def edge_softmax_stable(spark, d):
    return attention.edge_softmax(fx.edges(spark, d), _pair(spark, d), stable=True).select("eid", (F.round("p", 6) + F.lit(0.0)).alias("p"))


GAT_SQL = _with(OUT6.format("y"), E, _x(), _attn(), _scores(), _gat("x", "sc", "y"))


@query(GAT_SQL)
def gat_aggregate(spark, d):
    return _long(attention.gat_aggregate(fx.plain_edges(spark, d), fx.features(spark, d), _pair(spark, d), fx.vertices(spark, d), fx.WIDTH), digits=6)


@query(GAT_SQL)
def gat_grouped(spark, d):
    return _long(attention.gat_grouped(fx.plain_edges(spark, d), fx.features(spark, d), _pair(spark, d), fx.vertices(spark, d), fx.WIDTH), digits=6)


@query(GAT_SQL)
def gat_composed(spark, d):
    return _long(attention.gat_composed(fx.plain_edges(spark, d), fx.features(spark, d), _pair(spark, d), fx.vertices(spark, d), fx.WIDTH), digits=6)


@query(GAT_SQL)
def gat_semifused(spark, d):
    p = attention.edge_softmax(fx.plain_edges(spark, d).drop("val"), _pair(spark, d)).withColumnRenamed("p", "val")
    return _long(aggregate.spmm(p, fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH), digits=6)


#: Scores shifted to be positive, so that their sums are no denominators near 0.
SHIFT = 8.0


@query(_with(OUT6.format("y"), E, _x(), "attn0 AS (SELECT v, sum(x * (((k * 7) % 5 - 2) / 16.0e0)) AS a_dst, sum(x * (((k * 3) % 7 - 3) / 16.0e0)) AS a_src FROM x GROUP BY v), attn AS (SELECT v, a_dst + 8.0e0 AS a_dst, a_src FROM attn0)", _scores(None), _gat("x", "sc", "y")))
def gat_linear(spark, d):
    pair = _pair(spark, d).withColumn("a_dst", F.col("a_dst") + F.lit(SHIFT))
    return _long(attention.gat_linear(fx.plain_edges(spark, d), fx.features(spark, d), pair, fx.vertices(spark, d), fx.WIDTH), digits=6)


SDDMM = _with("SELECT eid, sum(a.x * b.x) AS s FROM e JOIN x a ON a.v = src JOIN x b ON b.v = dst AND b.k = a.k GROUP BY eid", E, _x())


@query(SDDMM)
def sddmm(spark, d):
    x = fx.features(spark, d)
    return edge_ops.sddmm(fx.edges(spark, d), x, x, fx.WIDTH).select("eid", "s")


@query(SDDMM)
def sddmm_grouped(spark, d):
    x = fx.features(spark, d)
    return edge_ops.sddmm_grouped(fx.edges(spark, d), x, x, fx.WIDTH).select("eid", "s")


MLP = _with(
    "SELECT h.v, h.k, coalesce(s.y, 0.0) AS y FROM h LEFT JOIN s USING (v, k)",
    E, _x(32), _w(32, 32), _mm("x", "w", "h"),
    "s AS (SELECT dst AS v, a.k, sum(greatest(a.x + b.x, 0.0)) AS y FROM e JOIN h a ON a.v = src JOIN h b ON b.v = dst AND b.k = a.k GROUP BY dst, a.k)",
)


@query(MLP)
def edge_mlp(spark, d):
    return _long(edge_ops.edge_mlp(fx.plain_edges(spark, d), fx.features(spark, d, 32), fx.weights(32, 32), fx.vertices(spark, d)))


@query(MLP)
def edge_mlp_grouped(spark, d):
    return _long(edge_ops.edge_mlp_grouped(fx.plain_edges(spark, d), fx.features(spark, d, 32), fx.weights(32, 32), fx.vertices(spark, d)))


@query(_with(OUT.format("h"), _x(), _w(fx.WIDTH, 32), _mm("x", "w", "h")))
def dense_matmul(spark, d):
    return _long(dense.matmul(fx.features(spark, d), fx.weights(fx.WIDTH, 32)))


@query(_with("SELECT v, k AS o, x AS y FROM h", _x(), _w(fx.WIDTH, 8), _mm("x", "w", "h")))
def dense_matmul_long(spark, d):
    w = fx.weights(fx.WIDTH, 8)
    table = spark.createDataFrame([(i, o, float(w[i, o])) for i in range(fx.WIDTH) for o in range(8)], "i long, o long, w double")
    return dense.matmul_long(aggregate.to_long(fx.features(spark, d)), table)


@query("SELECT count(*) AS n_active FROM embeddings WHERE vec_id % 3 = 0")
def count_active(spark, d):
    return fx.vertices(spark, d).where("v % 3 = 0").agg(F.count("*").alias("n_active"))


@query(_with("SELECT v, count(dst) AS deg FROM vs LEFT JOIN e ON dst = v GROUP BY v", E, V))
def degree(spark, d):
    return aggregate.degrees(fx.plain_edges(spark, d), fx.vertices(spark, d))


@query(_with("SELECT v, least(count(dst), 16) AS deg FROM vs LEFT JOIN e ON dst = v GROUP BY v", E, V))
def degree_capped(spark, d):
    return aggregate.degrees(fx.plain_edges(spark, d), fx.vertices(spark, d), 16)


SETS = "s AS (SELECT DISTINCT l_partkey AS v, l_suppkey AS u FROM lineitem), c AS (SELECT v, count(*) AS n FROM s GROUP BY v), p AS (SELECT x.v AS a, y.v AS b, count(*) AS common FROM s x JOIN s y ON x.u = y.u AND x.v < y.v GROUP BY ALL), j AS (SELECT a, b, common, common / (ca.n + cb.n - common) AS jaccard FROM p JOIN c ca ON ca.v = a JOIN c cb ON cb.v = b)"


@query(_with("SELECT a, b, common, round(jaccard, 9) + 0.0 AS jaccard FROM j", SETS))
def jaccard_pairs(spark, d):
    return reorder.jaccard_pairs(fx.neighbour_sets(spark, d), digits=9)


@query(_with("SELECT a, b, round(jaccard, 9) + 0.0 AS jaccard FROM j ORDER BY j.jaccard DESC, a, b LIMIT 100", SETS))
def pair_queue(spark, d):
    return reorder.queue(reorder.jaccard_pairs(fx.neighbour_sets(spark, d), top=100), 100).select("a", "b", (F.round("jaccard", 9) + F.lit(0.0)).alias("jaccard"))


SIGNATURE = """mh AS (SELECT v, ('0x' || left(md5(u::VARCHAR), 2))::BIGINT % 64 AS bin, min(('0x' || substr(md5(u::VARCHAR), 3, 8))::BIGINT) AS value FROM s GROUP BY ALL),
sg AS (SELECT v, i::BIGINT AS bin, min((bin - i + 64) % 64 * 4294967296 + value)::BIGINT AS value FROM mh, range(64) b(i) GROUP BY v, i)"""


@query(_with("SELECT v, bin, value FROM sg", SETS, SIGNATURE))
def minhash_signature(spark, d):
    return reorder.signatures(fx.neighbour_sets(spark, d)).select("v", F.posexplode("signature").alias("bin", "value")).withColumn("bin", F.col("bin").cast("long"))


@query(_with(
    "SELECT l.a, l.b, round(coalesce(jaccard, 0), 9) + 0.0 AS jaccard FROM lp l LEFT JOIN j ON j.a = l.a AND j.b = l.b", SETS, SIGNATURE,
    "bd AS (SELECT v, bin // 2 AS band, list(value ORDER BY bin) AS key FROM sg GROUP BY ALL)", "lp AS (SELECT DISTINCT x.v AS a, y.v AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.v < y.v)",
))
def lsh_candidates(spark, d):
    return reorder.lsh_pairs(fx.neighbour_sets(spark, d)).withColumn("jaccard", F.round("jaccard", 9) + F.lit(0.0))


@query()
def cluster_order(spark, d):
    fx.scratch(spark, "clusters")
    sets = fx.neighbour_sets(spark, d)
    pairs = similar.similar_pairs(sets, 0.2).select("a", "b", "jaccard")
    vertices = sets.select("v").distinct()
    return reorder.cluster_order(reorder.clusters(pairs, sets, vertices))


def _off(spark, d):
    """A result that is off in every seventh vertex."""
    y = aggregate.spmm(fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), fx.WIDTH)
    return y, y.select("v", F.transform("feat", lambda x: F.when(F.col("v") % 7 == 0, x * 1.5 + 1).otherwise(x)).alias("feat"))


@query(_with("SELECT count(*) AS n, sum(CASE WHEN v % 7 = 0 AND abs(x * 0.5e0 + 1) > abs(x) * 0.01e0 THEN 1 ELSE 0 END)::BIGINT AS wrong FROM y", E, _x(), _sum("x", "y")))
def validate_result(spark, d):
    truth, off = _off(spark, d)
    return validate.mismatches(off, truth)


@query(_with("SELECT count(*) AS n, sum(CASE WHEN v % 7 = 0 AND abs(x * 0.5e0 + 1) > 0.01e0 THEN 1 ELSE 0 END)::BIGINT AS wrong FROM y", E, _x(), _sum("x", "y")))
def validate_reordered(spark, d):
    truth, off = _off(spark, d)
    p = fx.permutation(spark, d)
    return validate.mismatches_reordered(reorder.permute_features(off, p), truth, p)


@query(_with(
    "SELECT f.v, f.k, round(f.x, 6) + 0.0 AS d_x FROM f",
    E, _x(), _attn(), _scores(), "q AS (SELECT eid, dst, src, z / sum(z) OVER (PARTITION BY dst) AS p FROM sc)",
    "f AS (SELECT src AS v, k, sum(p * x) AS x FROM q JOIN x ON x.v = dst GROUP BY src, k)",
))
def gat_backward(spark, d):
    x = fx.features(spark, d)
    d_feat, _ = attention.gat_backward(fx.plain_edges(spark, d), x, _pair(spark, d), x, fx.WIDTH)
    return _long(d_feat, "d_x", 6)


@query(_with(
    "SELECT coalesce(a.v, b.v) AS v, round(coalesce(a.g, 0), 6) + 0.0 AS d_dst, round(coalesce(b.g, 0), 6) + 0.0 AS d_src FROM a FULL JOIN b ON a.v = b.v",
    E, _x(), _attn(), _scores(None, out="raw"), "sc AS (SELECT eid, dst, src, z, exp(greatest(z, 0.2::DOUBLE * z)) AS ez FROM raw)",
    "q AS (SELECT *, ez / sum(ez) OVER (PARTITION BY dst) AS p FROM sc)",
    "i AS (SELECT eid, sum(s.x * t.x) AS g FROM q JOIN x s ON s.v = src JOIN x t ON t.v = dst AND t.k = s.k GROUP BY eid)",
    "m AS (SELECT q.*, g, sum(p * g) OVER (PARTITION BY dst) AS mean FROM q JOIN i USING (eid))",
    "dz AS (SELECT dst, src, p * (g - mean) * CASE WHEN z < 0 THEN 0.2::DOUBLE ELSE 1 END AS dz FROM m)",
    "a AS (SELECT dst AS v, sum(dz) AS g FROM dz GROUP BY dst), b AS (SELECT src AS v, sum(dz) AS g FROM dz GROUP BY src)",
))
def gat_backward_scores(spark, d):
    x = fx.features(spark, d)
    _, d_attn = attention.gat_backward(fx.plain_edges(spark, d), x, _pair(spark, d), x, fx.WIDTH)
    return d_attn.select("v", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("d_dst", "d_src")])


# --- prefix sums and positions --------------------------------------------------------------------------------------


@query(_with("SELECT v, (coalesce(sum(f) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS prefix FROM (SELECT v, CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END AS f FROM vs) t", V))
def prefix_sum(spark, d):
    flags = fx.vertices(spark, d).withColumn("f", F.when(F.col("v") % 3 == 0, 1).otherwise(0))
    return order.exclusive_prefix(flags, "v", "f", "prefix").select("v", "prefix")


@query(_with("SELECT row_number() OVER (ORDER BY v) - 1 AS row, v, (coalesce(sum(deg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin, deg FROM (SELECT v, count(dst) AS deg FROM vs LEFT JOIN e ON dst = v WHERE v % 3 = 0 GROUP BY v) t", E, V))
def compact_ptr(spark, d):
    deg = aggregate.degrees(fx.plain_edges(spark, d), fx.vertices(spark, d))
    return order.compacted(fx.vertices(spark, d).where("v % 3 = 0"), deg)


@query(_with("SELECT eid, row_number() OVER (PARTITION BY dst ORDER BY eid) - 1 AS step FROM e", E))
def neighbour_position(spark, d):
    return order.position_in_row(fx.edges(spark, d)).select("eid", "step")


# --- schedules ------------------------------------------------------------------------------------------------------


def _tasks_sql(ranged: bool, chunked: bool, body: str) -> str:
    part = "least(src // (n // 4), 3)" if ranged else "0"
    grp = "(row_number() OVER (PARTITION BY part, dst ORDER BY eid) - 1) // 32" if chunked else "0"
    return _with(
        body, E, f"r AS (SELECT eid, dst, src, val, {part} AS part FROM e, n), g AS (SELECT *, {grp} AS grp FROM r)",
        "t AS (SELECT row_number() OVER (ORDER BY part, dst, grp) - 1 AS task_id, dst, part::BIGINT AS part, grp::BIGINT AS grp, count(*) AS size FROM g GROUP BY dst, part, grp)",
    )


TASKS = "SELECT *, (coalesce(sum(size) OVER (ORDER BY task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM t"


def _task_table(spark, d, kind):
    return schedule.tasks(_tasked(spark, d, kind)).select("task_id", "dst", "part", "grp", "size", "ptr")


@query(_tasks_sql(False, True, TASKS))
def sched_ng(spark, d):
    return _task_table(spark, d, Schedule.NEIGHBOR_GROUPING)


@query(_tasks_sql(True, False, TASKS))
def sched_locality(spark, d):
    return _task_table(spark, d, Schedule.LOCALITY)


@query(_tasks_sql(True, True, TASKS))
def sched_locality_ng(spark, d):
    return _task_table(spark, d, Schedule.LOCALITY_NEIGHBOR_GROUPING)


@query(_tasks_sql(False, False, TASKS))
def sched_nop(spark, d):
    return _task_table(spark, d, Schedule.NOP)


@query(_tasks_sql(True, True, "SELECT row_number() OVER (ORDER BY g.part, g.dst, g.grp, eid) - 1 AS pos, task_id, src, val FROM g JOIN t ON t.dst = g.dst AND t.part = g.part AND t.grp = g.grp"))
def sched_edges(spark, d):
    return schedule.task_edges(_tasked(spark, d, Schedule.LOCALITY_NEIGHBOR_GROUPING))


@query(_tasks_sql(False, True, "SELECT count(*) AS n_tasks, sum(size)::BIGINT AS n_edges, min(size) AS least, max(size) AS most, sum((size < 32)::INT)::BIGINT AS n_small, sum((size = 0)::INT)::BIGINT AS n_empty FROM t"))
def task_stats(spark, d):
    return schedule.task_stats(schedule.tasks(_tasked(spark, d)))


# --- reordering and sampling ----------------------------------------------------------------------------------------

REORDER = "p AS (SELECT (v * 7 + 3) % n AS pos, v FROM vs, n), r AS (SELECT row_number() OVER (ORDER BY a.pos, e.eid) - 1 AS eid, a.pos AS dst, b.pos AS src, val FROM e JOIN p a ON a.v = e.dst JOIN p b ON b.v = e.src)"


@query(_with("SELECT eid, dst, src, val FROM r", E, V, REORDER))
def reorder_csr(spark, d):
    return reorder.permute(fx.edges(spark, d), fx.permutation(spark, d))


@query(_with("SELECT p.pos AS v, k, x AS y FROM y JOIN p USING (v)", E, V, REORDER, _x(), _sum("x", "y")))
def spmm_reordered(spark, d):
    p = fx.permutation(spark, d)
    return _long(aggregate.spmm(reorder.permute(fx.edges(spark, d), p), reorder.permute_features(fx.features(spark, d), p), fx.vertices(spark, d), fx.WIDTH))


ACTIVE0 = "f0 AS (SELECT v FROM vs WHERE v % 50 = 0)"


def _expand_sql(layers: int, edges: str = "e") -> str:
    return ", ".join(f"f{i + 1} AS (SELECT v FROM f{i} UNION SELECT src FROM {edges} WHERE dst IN (SELECT v FROM f{i}))" for i in range(layers - 1))


@query(_with("SELECT v FROM f2", E, V, ACTIVE0, _expand_sql(3)))
def frontier_khop(spark, d):
    return sample.frontier(fx.vertices(spark, d).where("v % 50 = 0"), fx.plain_edges(spark, d), 3)


ROWS = "rows_ AS (SELECT row_number() OVER (ORDER BY v) - 1 AS row, v FROM {})"


@query(_with("SELECT row, dst, src, eid FROM e JOIN rows_ ON v = dst", E, V, ACTIVE0, _expand_sql(2), ROWS.format("f1")))
def subgraph_full(spark, d):
    edges = fx.edges(spark, d)
    return sample.subgraph(sample.frontier(fx.vertices(spark, d).where("v % 50 = 0"), edges, 2), edges)[1]


CHOSEN = "ch AS (SELECT eid, dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY left(md5(concat('0:', dst, ':', src)), 16), src) AS rn FROM e) t WHERE rn <= 8)"


@query(_with("SELECT eid, dst, src FROM ch", E, CHOSEN))
def sample_neighbours(spark, d):
    return sample.chosen_neighbours(fx.edges(spark, d), 8).select("eid", "dst", "src")


@query(_with("SELECT row, dst, src, eid FROM ch JOIN rows_ ON v = dst", E, V, CHOSEN, ACTIVE0, _expand_sql(3, "ch"), ROWS.format("f2")))
def subgraph_sampled(spark, d):
    return sample.sampled_subgraph(fx.vertices(spark, d).where("v % 50 = 0"), fx.edges(spark, d), 8, 3)[1]


@query(_with("SELECT eid, dst, src, 1.0e0 AS val FROM r", E, V, REORDER))
def load_reordered(spark, d):
    """A graph on disk, loaded in the order that a permutation file names."""
    path, n = fx.scratch(spark, "ordered"), fx.size(spark, d)
    edges = fx.edges(spark, d)
    edges.agg(F.concat_ws(" ", F.lit(n), F.count("*")).alias("value")).coalesce(1).write.text(f"{path}.config")
    files.write_csr_text(edges, fx.vertices(spark, d), f"{path}.graph")
    files.write_permutation(fx.permutation(spark, d), f"{path}.reorder")
    return api.load_graph(spark, path, "text", f"{path}.reorder")[0]


@query(_with("SELECT printf('%.6f', deg::DOUBLE) AS value FROM (SELECT v, count(dst) AS deg FROM vs LEFT JOIN e ON dst = v GROUP BY v) t, range(2)", E, V))
def append_log(spark, d):
    """A log of a line a number, appended to twice and read."""
    path = fx.scratch(spark, "log")
    numbers = aggregate.degrees(fx.plain_edges(spark, d), fx.vertices(spark, d)).select(F.col("deg").cast("double"))
    for _ in range(2):
        files.append_log(numbers, path)
    return spark.read.text(path)


# --- models ---------------------------------------------------------------------------------------------------------


#: The widths of the published models: features, two hidden layers, outputs.
MODEL = [512, 128, 64, 32]


def _features_sql(width: int) -> str:
    return _x(width) if width <= fx.WIDTH else _tiled(width)


def _model_features(spark, d, width: int) -> DataFrame:
    return fx.features(spark, d, width) if width <= fx.WIDTH else fx.tiled_features(spark, d, width)


def _gcn_sql(widths: list[int], formula: str) -> str:
    parts, at = [E, _features_sql(widths[0])], "x"
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        parts += [_w(a, b, f"w{i}", formula), _mm(at, f"w{i}", f"h{i}"), _sum(f"h{i}", f"s{i}", "x"), _relu(f"s{i}", f"l{i}")]
        at = f"l{i}"
    return _with(OUT.format(at), *parts)


def _gcn(spark, d, widths, make):
    return _long(models.gcn(fx.plain_edges(spark, d), _model_features(spark, d, widths[0]), fx.vertices(spark, d), stack(widths, make)))


@query(_gcn_sql([64, 32], "((i * 31 + o * 17) % 23 - 11) / 16.0e0"))
def gcn_layer(spark, d):
    return _gcn(spark, d, [64, 32], fx.weights)


@query(_gcn_sql([64, 16, 8], SMALL))
def gcn_2layer(spark, d):
    return _gcn(spark, d, [64, 16, 8], fx.small_weights)


@query(_gcn_sql([64, 16, 8], SMALL))
def model_by_name(spark, d):
    return _long(api.run("GCN", fx.plain_edges(spark, d), fx.features(spark, d), fx.vertices(spark, d), stack([64, 16, 8], fx.small_weights)))


@query(_gcn_sql(MODEL, SMALL))
def gcn_3layer(spark, d):
    return _gcn(spark, d, MODEL, fx.small_weights)


def _gat_sql(widths: list[int], formula: str) -> str:
    parts, at = [E, _features_sql(widths[0])], "x"
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        parts += [_w(a, b, f"w{i}", formula), _mm(at, f"w{i}", f"h{i}"), _attn(f"h{i}", f"a{i}"), _scores(0.2, f"a{i}", f"sc{i}"), _gat(f"h{i}", f"sc{i}", f"l{i}")]
        at = f"l{i}"
    return _with(OUT6.format(at), *parts)


def _gat_model(spark, d, widths):
    layers = [(w, fx.attention(w.shape[1])) for w in stack(widths, fx.small_weights)]
    return _long(models.gat(fx.plain_edges(spark, d), _model_features(spark, d, widths[0]), fx.vertices(spark, d), layers), digits=6)


@query(_gat_sql([64, 16], SMALL))
def gat_layer(spark, d):
    return _gat_model(spark, d, [64, 16])


@query(_gat_sql(MODEL, SMALL))
def gat_3layer(spark, d):
    return _gat_model(spark, d, MODEL)


@query(_with(OUT.format("h1"), _x(), _w(64, 16, "w0", SMALL), _mm("x", "w0", "h0", True), _w(16, 8, "w1", SMALL), _mm("h0", "w1", "h1", True)))
def dense_only(spark, d):
    return _long(models.dense_only(fx.features(spark, d), stack([64, 16, 8], fx.small_weights)))


#: Hidden and input width of the LSTM queries.
HIDDEN = fx.WIDTH
_SIG = "(1 / (1 + exp(-z[{}])))"
LSTM = _with(
    f"SELECT v, unnest(range({HIDDEN}))::BIGINT AS k, round(unnest(h), 6) + 0.0 AS y FROM st WHERE t = {fx.NEIGHBOURS}",
    E, _x(HIDDEN), _w(HIDDEN, 4 * HIDDEN), "gl AS (SELECT v, list(y ORDER BY o) AS g FROM (SELECT v, o, sum(x * w) AS y FROM x JOIN w ON k = i GROUP BY v, o) GROUP BY v)",
    f"u AS (SELECT list(r ORDER BY o) AS r FROM (SELECT o, list(((i * 13 + o * 7) % 17 - 8) / 32.0e0 ORDER BY i) AS r FROM range({HIDDEN}) a(i), range({4 * HIDDEN}) b(o) GROUP BY o))",
    f"nb AS (SELECT dst, src, rn FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn, count(*) OVER (PARTITION BY dst) AS c FROM e) t WHERE rn <= {fx.NEIGHBOURS} AND c >= {fx.NEIGHBOURS})",
    f"""st(v, t, h, c) AS (
      SELECT DISTINCT dst, 0, list_transform(range({HIDDEN}), lambda i: 0.0::DOUBLE), list_transform(range({HIDDEN}), lambda i: 0.0::DOUBLE) FROM nb
      UNION ALL
      SELECT v, t, list_transform(range({HIDDEN}), lambda j: {_SIG.format('j + 1')} * ((exp(2 * c[j + 1]) - 1) / (exp(2 * c[j + 1]) + 1))), c FROM (
        SELECT v, t, z, list_transform(range({HIDDEN}), lambda j: {_SIG.format(f'{2 * HIDDEN} + j + 1')} * c[j + 1] + {_SIG.format(f'{3 * HIDDEN} + j + 1')} * tanh(z[{HIDDEN} + j + 1])) AS c FROM (
          SELECT st.v, st.t + 1 AS t, st.c, list_transform(list_zip(g, r), lambda p: p[1] + list_dot_product(st.h, p[2])) AS z
          FROM st JOIN nb ON nb.dst = st.v AND nb.rn = st.t + 1 JOIN gl ON gl.v = nb.src, u)))""",
    recursive=True,
)


def _lstm(spark, d, bypass):
    out = lstm.sage_lstm(fx.edges(spark, d), fx.features(spark, d, HIDDEN), fx.weights(HIDDEN, 4 * HIDDEN), fx.recurrent(HIDDEN), fx.NEIGHBOURS, bypass)
    return _long(out, digits=6)


@query(LSTM)
def sage_lstm_base(spark, d):
    return _lstm(spark, d, False)


@query(LSTM)
def sage_lstm_bypass(spark, d):
    return _lstm(spark, d, True)


# --- timings and logs -----------------------------------------------------------------------------------------------

TIMERS = "tm AS (SELECT l_orderkey * 8 + l_linenumber AS task_id, l_suppkey % 80 AS slot, l_orderkey * 1000 AS begin_ns, l_orderkey * 1000 + (l_quantity * 100)::BIGINT + l_linenumber AS end_ns FROM lineitem)"


def _timers(spark, d):
    begin = F.col("l_orderkey") * 1000
    return fx.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task_id"), (F.col("l_suppkey") % 80).alias("slot"), begin.alias("begin_ns"), (begin + (F.col("l_quantity") * 100).cast("long") + F.col("l_linenumber")).alias("end_ns")
    )


@query(_with("SELECT sum(end_ns - begin_ns) / 80 AS balanced, max(end_ns) - min(begin_ns) AS actual FROM tm", TIMERS))
def load_balance(spark, d):
    return metrics.balance(_timers(spark, d), 80)


@query()
def spmm_timed(spark, d):
    """Busy time over slots against wall time, of plain sums and of sums by group."""
    x, v = fx.features(spark, d), fx.vertices(spark, d)
    plain = metrics.task_records(aggregate.spmm(fx.plain_edges(spark, d), x, v, fx.WIDTH))
    grouped = metrics.task_records(aggregate.spmm_grouped(fx.plain_edges(spark, d), x, v, fx.WIDTH))
    slots = spark.sparkContext.defaultParallelism
    return metrics.balance(plain, slots).withColumn("plan", F.lit("plain")).unionByName(metrics.balance(grouped, slots).withColumn("plan", F.lit("grouped")))


@query(_with("SELECT task_id, slot, end_ns FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY end_ns DESC, task_id) AS rn FROM tm) t WHERE rn <= 4", TIMERS))
def last_tasks(spark, d):
    return metrics.last_by_slot(_timers(spark, d), 4).select("task_id", "slot", "end_ns")


@query(_with("SELECT name, num_e, round(2.0e0 * num_e * 32 / 0.5e0 / 1e9, 9) + 0.0 AS gflops FROM c", "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {c})" for a, _, c in catalog.DATASETS) + ") t(name, num_e))").replace("SELECT name, num_e,", "SELECT name, num_e::BIGINT AS num_e,"))
def gflops_by_dataset(spark, d):
    return catalog.datasets(spark).select("name", "num_e", (F.round(gflops(F.col("num_e"), F.lit(32), F.lit(0.5)), 9) + F.lit(0.0)).alias("gflops"))


@query("SELECT o_orderpriority AS name, round(avg(o_orderkey % 1000), 6) + 0.0 AS mean FROM orders WHERE o_orderkey % 5 >= 3 GROUP BY 1")
def mean_runs(spark, d):
    runs = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 5).alias("run"), (F.col("o_orderkey") % 1000).alias("seconds"))
    return metrics.mean_runs(runs).select("name", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


TIMES = "tt AS (SELECT c_mktsegment AS dataset, ['ours', 'dgl', 'pyg'][1 + c_custkey % 3] AS variant, sum(c_custkey % 97)::DOUBLE AS t FROM customer GROUP BY ALL)"


def _times(spark, d):
    variant = F.get(F.array(F.lit("ours"), F.lit("dgl"), F.lit("pyg")), (F.col("c_custkey") % 3).cast("int"))
    return fx.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("dataset"), variant.alias("variant")).agg(F.sum(F.col("c_custkey") % 97).cast("double").alias("t"))


@query(_with("SELECT dataset, variant, round(t / (max(t) OVER (PARTITION BY dataset) + 1e-16), 9) + 0.0 AS share FROM tt", TIMES))
def normalize_max(spark, d):
    return metrics.over_greatest(_times(spark, d), "dataset", "t", least=1e-16).select("dataset", "variant", (F.round("share", 9) + F.lit(0.0)).alias("share"))


@query(_with("SELECT dataset, variant, round(t / b, 9) + 0.0 AS share, round(t / b - 1, 9) + 0.0 AS above FROM (SELECT *, max(CASE WHEN variant = 'dgl' THEN t END) OVER (PARTITION BY dataset) AS b FROM tt) x", TIMES))
def normalize_baseline(spark, d):
    out = metrics.over_baseline(_times(spark, d), "dataset", "variant", "dgl", "t")
    return out.select("dataset", "variant", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("share", "above")])


@query(_with("SELECT dataset, max(t) AS greatest, max(CASE WHEN rn = 2 THEN t END) AS second, min(CASE WHEN t > 0 THEN t END) AS least_positive, coalesce(max(t) / max(CASE WHEN rn = 2 THEN t END) > 100, false) AS log_axis FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t DESC) AS rn FROM tt) x GROUP BY dataset", TIMES))
def axis_facts(spark, d):
    return metrics.axis_facts(_times(spark, d), "dataset", "t")


LOG = "lg AS (SELECT c_custkey, concat('DGL figure7 time ', c_mktsegment, ' ', CASE WHEN c_custkey % 11 = 0 THEN 'OOM' ELSE c_custkey::VARCHAR || '%' END, CASE WHEN c_custkey % 2 = 0 THEN ' done' ELSE '' END) AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, concat('loss=', c_custkey, ' step') FROM customer WHERE c_custkey % 3 = 0)"


def _log(spark, d):
    key = F.col("c_custkey")
    told = F.concat(F.lit("DGL figure7 time "), F.col("c_mktsegment"), F.lit(" "), F.when(key % 11 == 0, F.lit("OOM")).otherwise(F.concat(key.cast("string"), F.lit("%"))), F.when(key % 2 == 0, F.lit(" done")).otherwise(F.lit("")))
    line = F.when(key % 3 != 0, told).otherwise(F.concat(F.lit("loss="), key.cast("string"), F.lit(" step")))
    return fx.table(spark, d, "customer").select("c_custkey", line.alias("value"))


@query(_with("SELECT value, w AS word, try_cast(replace(w, '%', '') AS DOUBLE) AS number FROM (SELECT value, string_split(value, ' ')[5] AS w FROM lg WHERE value LIKE '%figure7%') x", LOG))
def parse_log(spark, d):
    return metrics.token(_log(spark, d), "figure7", 5).select("value", "word", "number")


@query(_with("SELECT c_custkey, try_cast(regexp_extract(value, 'loss\\s*=\\s*([-+0-9.eE]+)', 1) AS DOUBLE) AS loss FROM lg", LOG))
def extract_number(spark, d):
    return _log(spark, d).select("c_custkey", metrics.keyed_number(F.col("value"), "loss").alias("loss"))


@query(_with("SELECT c_custkey, value FROM lg WHERE c_custkey % 2 = 0", LOG))
def alternate_lines(spark, d):
    return metrics.every_other(_log(spark, d), "c_custkey")


RESULTS = "rs AS (SELECT ['ours', 'dgl', 'pyg'][1 + c_custkey % 3] AS framework, c_mktsegment AS app, c_nationkey AS dataset, CASE WHEN c_custkey % 11 = 0 THEN 'OOM' ELSE c_custkey::VARCHAR END AS text FROM customer)"


@query(_with("SELECT app, dataset, " + ", ".join(f"max(CASE WHEN framework = '{f}' THEN greatest(coalesce(try_cast(text AS DOUBLE), 0.0), 1e-16) END) AS {f}" for f in ("ours", "dgl", "pyg")) + " FROM rs GROUP BY ALL", RESULTS))
def result_matrix(spark, d):
    key = F.col("c_custkey")
    variant = F.get(F.array(F.lit("ours"), F.lit("dgl"), F.lit("pyg")), (key % 3).cast("int"))
    rows = fx.table(spark, d, "customer").select(variant.alias("framework"), F.col("c_mktsegment").alias("app"), F.col("c_nationkey").alias("dataset"), F.when(key % 11 == 0, F.lit("OOM")).otherwise(key.cast("string")).alias("text"))
    return metrics.result_matrix(rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'OUT OF MEMORY' WHEN c_custkey % 4 = 1 THEN 'OUT OF SUPPORT' END AS label FROM customer")
def missing_labels(spark, d):
    key = F.col("c_custkey")
    value = F.when(key % 4 == 0, F.lit(0.0)).when(key % 4 == 1, F.lit(1e-16)).otherwise(key.cast("double"))
    return fx.table(spark, d, "customer").select("c_custkey", metrics.missing_label(value).alias("label"))


@query(_with("SELECT c_custkey, name, num_e FROM (SELECT c_custkey, ['arxiv', 'ddi', 'none'][1 + c_custkey % 3] AS name FROM customer) p LEFT JOIN c USING (name)", "c AS (SELECT name, num_e::BIGINT AS num_e FROM (VALUES " + ", ".join(f"('{a}', {c})" for a, _, c in catalog.DATASETS) + ") t(name, num_e))"))
def catalog_lookup(spark, d):
    names = F.get(F.array(F.lit("arxiv"), F.lit("ddi"), F.lit("none")), (F.col("c_custkey") % 3).cast("int"))
    rows = fx.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("../data/"), names).alias("path"))
    return catalog.lookup(rows, catalog.datasets(spark)).select("c_custkey", "name", "num_e")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


