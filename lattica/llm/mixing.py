"""Mixing sources to target weights by Pareto order sampling, with Spark expressions only.

A document of a source with target t and size s is expected t / s times. The whole part is taken for certain; the rest is
drawn. Documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), where p is the
part of its source that remains to be drawn: unequal between sources, and equal inside one unless a column of weights
says otherwise. No other number enters, so odds are the same in small and large tables. Ranks of all sources are on one
scale, on which a sample ends near 1; to hold each source to its words, its own sample ends where they run out. What its
last document leaves open goes to the next by rank, one of each power of two of sizes, that still fit. Only a document too
long for the words that its source has left at that place is taken less often than p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A rank is held as 40 bits; a histogram level resolves 12 of them.
_BITS, _LEVEL = 40, 12
#: Sources up to which their table is broadcast (some 100 bytes each); beyond it, joins shuffle.
MOST_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allocate(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    Sources by code point, null last, have the weights in turn. A target stops at `most` times the source's size and
    the excess is shared by weight among the rest, again and again. The end of that is a water level: sources are
    filled by ascending capacity / weight, and each open one gets level x weight. One task orders the sources.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(given, (F.row_number().over(by_name) - 1) % n)).withColumn("capacity", F.col("source_size").cast("double") * most)
    by_level = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("full")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("capacity"), F.struct(F.row_number().over(by_level).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    )
    target = F.least(F.col("capacity"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _unit(key: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)


def inclusion_odds(part: Column, weight: Column) -> Column:
    """The odds of a document of a source of which `part` is drawn; the cut sets a factor for the whole source."""
    return part / (1 - part) * weight


def _small(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= MOST_BROADCAST else side


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 20240229, favour: str | None = None) -> DataFrame:
    """key, size, source_size, target, copies, taken of each row: how often the mix holds a document, and its words.

    Size is the number of words (null or empty text: 0 words, and whatever copies fall to it, 0 words taken). A null
    source is a source of its own, last in order. Ties of rank go by size; rows equal in key and size
    share their fate. `favour` names a column of positive numbers by which a document's odds of being drawn are
    multiplied, among those of its source (null, zero or less: 1). A source without words gets target 0. A very long text is one document: it is never cut. An empty table gives no rows; other columns are ignored. Texts are read once;
    only (key, source, size, rank) is written to the shared folder. A hot source is never one task: its cut is found
    in histograms of rank, summed before they shuffle, and only the last bucket's rows are ordered.
    """
    favoured = F.lit(1.0) if favour is None else F.when(F.col(favour) > 0, F.col(favour).cast("double")).otherwise(F.lit(1.0))
    light = materialise(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), favoured.alias("favour")), "mix")
    targets = allocate(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = materialise(
        targets.withColumn("expected", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0))
        .withColumn("whole", F.floor("expected"))
        .withColumn("part", F.col("expected") - F.col("whole"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    n = targets.count()
    u = _unit(F.col("key"), seed)
    odds = (u / (1 - u)) / inclusion_odds(F.col("part"), F.col("favour"))
    level = lambda shift: F.shiftright("rank", shift).bitwiseAND(F.lit((1 << _LEVEL) - 1)) if shift < _BITS - _LEVEL else F.shiftright("rank", shift)
    t = _small(targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "part", "left"), n)
    ranked = (
        light.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("rank", F.when(F.col("part") > 0, F.least(F.floor(odds / (1 + odds) * float(1 << _BITS)), F.lit((1 << _BITS) - 1))))
        .withColumn("b1", level(_BITS - _LEVEL))
        .withColumn("b2", level(_BITS - 2 * _LEVEL))
    )

    def cut(rows: DataFrame, bucket: str, by: list[str]) -> DataFrame:
        """The bucket of each source in which the words left run out, and the words left at its start."""
        sums = rows.groupBy(*by, bucket).agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy(*by)
        first = found.agg(F.min(F.struct(F.col(bucket), (F.col("left") - F.col("upto") + F.col("words")).alias("left"))).alias("first"))
        return first.select(F.col("source").alias(f"{bucket}_source"), F.col(f"first.{bucket}").alias(f"cut_{bucket}"), F.col("first.left").alias(f"left_{bucket}"))

    drawn = ranked.where("part > 0")
    one = materialise(cut(drawn.select("source", "b1", "size", "left"), "b1", ["source"]), "mix-cut")
    with_one = ranked.join(_small(one, n), F.col("source").eqNullSafe(F.col("b1_source")), "left")
    inner = with_one.where("part > 0 and b1 = cut_b1").select("source", "b2", "size", F.col("left_b1").alias("left"))
    two = materialise(cut(inner, "b2", ["source"]), "mix-cut")
    both = with_one.join(_small(two, n), F.col("source").eqNullSafe(F.col("b2_source")), "left")
    edge = both.where("part > 0 and b1 = cut_b1 and b2 = cut_b2").select("source", "key", "rank", "size", "left_b2")
    order = Window.partitionBy("source").orderBy("rank", "size", "key")  # one bucket of 2^24 a source
    ties = edge.groupBy("source", "rank", "size", "key").agg(F.count("*").alias("n"), F.max("left_b2").alias("left_b2"))
    upto = F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = ties.withColumn("upto", upto).where("upto <= left_b2").select(F.col("source").alias("e_source"), F.col("key").alias("e_key"), F.col("rank").alias("e_rank"), F.col("size").alias("e_size"))
    last = materialise(last, "mix-edge")
    full = both.join(
        _small(last, last.count()),
        F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").eqNullSafe(F.col("e_key")) & (F.col("rank") == F.col("e_rank")) & (F.col("size") == F.col("e_size")),
        "left",
    )
    below = F.col("cut_b1").isNull() | (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2"))))
    drawn = full.withColumn("drawn", (F.col("part") > 0) & (below | F.col("e_rank").isNotNull()))
    drawn = materialise(drawn.select("key", "source", "size", "source_size", "target", "whole", "part", "left", "rank", "drawn"), "mix-drawn")
    # the words that the sample lacks at its end: the next by rank of each power of two of sizes, large ones first
    lack = drawn.groupBy("source").agg((F.max("left") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("lack")).withColumnRenamed("source", "l_source")
    open_ = drawn.where("part > 0 and not drawn and size > 0").join(_small(lack, n), F.col("source").eqNullSafe(F.col("l_source"))).where("size <= lack")
    first = open_.groupBy("source", F.floor(F.log2("size")).alias("power")).agg(F.min(F.struct("rank", "size", "key")).alias("next"), F.max("lack").alias("lack"))
    first = materialise(first.select(F.col("source").alias("f_source"), "lack", *[F.col(f"next.{c}").alias(f"f_{c}") for c in ("rank", "size", "key")]), "mix-next")
    m = first.count()
    same = F.col("source").eqNullSafe(F.col("f_source")) & F.col("key").eqNullSafe(F.col("f_key")) & (F.col("rank") == F.col("f_rank")) & (F.col("size") == F.col("f_size"))
    one = F.struct(F.col("f_size").alias("size"), F.col("f_rank").alias("rank"), F.col("f_key").alias("key"), F.col("n"))
    queue = open_.drop("lack").join(_small(first, m), same).groupBy("f_source", "lack", "f_size", "f_rank", "f_key").agg(F.count("*").alias("n"))  # rows equal in key and size
    queue = queue.groupBy("f_source", "lack").agg(F.sort_array(F.collect_list(one), asc=False).alias("queue"))  # a struct per power of two
    nothing = F.struct(F.col("lack").alias("lack"), F.filter("queue", lambda _: F.lit(False)).alias("taken"))
    fits = lambda state, x: F.when(
        x["size"] * x["n"] <= state["lack"], F.struct((state["lack"] - x["size"] * x["n"]).alias("lack"), F.concat(state["taken"], F.array(x)).alias("taken"))
    ).otherwise(state)
    taken = queue.select("f_source", F.explode(F.aggregate("queue", nothing, fits)["taken"]).alias("x"))
    taken = taken.select("f_source", *[F.col(f"x.{c}").alias(f"f_{c}") for c in ("rank", "size", "key")])
    out = drawn.join(_small(taken, m), same, "left")
    copies = (F.col("whole") + (F.col("drawn") | F.col("f_rank").isNotNull()).cast("long")).cast("long")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
