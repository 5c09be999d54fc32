"""Pairs of similar sets at a threshold: prefix and length filters over members in the order of their frequency.

Members are numbered from the rarest to the commonest. Two sets of sizes n and m with similarity t or more share one of
their first n - ceil(t n) + 1 members, and m is at least t n. So sets meet under the members of their prefixes only; a
pair is scored, on whole sets, under the rarest member that it shares, which lies in both prefixes, and nowhere else.
What is shuffled grows with the prefixes, not with the square of the number of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .order import number_rows

#: Sets of a block under one member, and of a chunk that meets the other block at once; members of a set up to which it
#: travels whole; rows of a table that is broadcast.
BLOCK, CHUNK, LARGE, MOST_BROADCAST = 1024, 64, 2048, 50_000
PAIR = "a long, b long, common long, jaccard double"


def ordered_sets(sets: DataFrame) -> DataFrame:
    """v, s: each set of (v, u) as an ascending array of its members' numbers, the rarest member of all sets being 0."""
    pairs = written(sets.where("v IS NOT NULL AND u IS NOT NULL").select("v", "u").distinct(), "members")
    numbers = number_rows(pairs.groupBy("u").agg(F.count("*").alias("n")), ["n", "u"], "r").select("u", "r")
    return pairs.join(numbers, "u").groupBy("v").agg(F.sort_array(F.collect_list("r")).alias("s"))


def prefix(least: float):
    """How many of a set's rarest members every similar set shares one of."""
    n = F.size("s")
    return (n - F.ceil(n * F.lit(least) - 1e-9) + 1).cast("int")


def _dealt(tokens: DataFrame) -> DataFrame:
    """Adds the groups (i, j) that a set takes part in under a member: one, or, where the member has more than BLOCK sets,
    one for each block beside its own. Members of one set are dropped: no pair meets there."""
    counts = written(tokens.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "member-counts")
    few = counts.count() <= MOST_BROADCAST
    rows = tokens.join(F.broadcast(counts) if few else counts, "r")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    # a block meets itself once, and each later block as the left of the two
    left = rows.select("*", F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j")).select("r", F.col("own").alias("i"), "j", F.lit(0).alias("side"), "v", "s")
    right = rows.where("own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i")).select("r", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "v", "s")
    return left.unionByName(right)


def _pairs(r: int, left: list, right: list | None, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, common, jaccard) of similar pairs between two lists of (v, s), or within one, whose first common member is r.
    CHUNK sets of the left meet all of the other list at once: each member's owners are counted in one array."""
    other = left if right is None else right
    w = np.array([v for v, _ in other], np.int64)
    m = np.array([len(s) for _, s in other])
    members, of = np.unique(np.concatenate([s for _, s in other]), return_inverse=True)
    owner = np.repeat(np.arange(len(w)), m)[np.argsort(of, kind="stable")]
    key = np.sort(of) * len(w) + owner  # ascending: a member's owners from any row on are one run
    ends = np.cumsum(np.bincount(of, minlength=len(members)))
    for first in range(0, len(left), CHUNK):
        part = left[first : first + CHUNK]
        v, n = np.array([x for x, _ in part], np.int64), np.array([len(s) for _, s in part])
        flat, row = np.concatenate([s for _, s in part]), np.repeat(np.arange(len(part)), n)
        at = np.searchsorted(members, flat).clip(max=len(members) - 1)
        known = members[at] == flat
        begin = first if right is None else 0  # within one list, later sets only
        width = len(w) - begin

        def counts(which: np.ndarray) -> np.ndarray:
            place = at[which]  # noqa: B023
            start = np.searchsorted(key, place * len(w) + begin)  # noqa: B023
            times = ends[place] - start
            met = owner[np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())] - begin  # noqa: B023
            return np.bincount(met + np.repeat(row[which], times) * width, minlength=len(part) * width)  # noqa: B023

        common = counts(known)
        # the smallest sets need so many common members, all others more
        hit = np.flatnonzero(common >= max(1, (least - 1e-9) * (n.min() + m[begin:].min()) / (1 + least)))
        i, j, common = hit // width, hit % width, common[hit]
        jaccard = common / (n[i] + m[begin + j] - common)
        fits = (jaccard >= least - 1e-12) & (v[i] != w[begin + j])
        if right is None:
            fits &= j > i
        if fits.any():
            fits &= counts(known & (flat < r))[hit] == 0
            i, j = i[fits], begin + j[fits]
            if len(i):
                yield np.minimum(v[i], w[j]), np.maximum(v[i], w[j]), common[fits], jaccard[fits]


def _scored(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups (r, i, j) follow each other; one is held at a time, of two blocks at most."""
        at, held, out = None, ([], []), []

        def close() -> None:
            if at and (at[1] == at[2] or (held[0] and held[1])):
                out.extend(_pairs(at[0], held[0], None if at[1] == at[2] else held[1], least))

        def passed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "common", "jaccard"])

        for batch in batches:
            flat, ends = batch.column("s").flatten().to_numpy(zero_copy_only=False), batch.column("s").offsets.to_numpy()
            ends = ends - ends[0]
            for k, (r, i, j, side, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("r", "i", "j", "side", "v")), strict=True)):
                if (r, i, j) != at:
                    close()
                    at, held = (r, i, j), ([], [])
                held[side].append((v, flat[ends[k] : ends[k + 1]]))
            if out:
                yield passed()
        close()
        if out:
            yield passed()

    return run


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """a, b, common, jaccard for a < b of sets(v, u) with a similarity of `least` (above 0) or more; each pair once.

    Nulls are no members, repeated rows count once, empty sets are similar to nothing. Members common to many sets are
    met in blocks, and sets of more than LARGE members are compared by joins on their members, so no task holds more than
    two blocks of sets.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    whole = written(ordered_sets(sets), "sets")
    tokens = whole.where(F.size("s") <= LARGE).select("v", "s", F.explode(F.slice("s", F.lit(1), prefix(least))).alias("r"))
    groups = _dealt(tokens).repartition("r", "i", "j").sortWithinPartitions("r", "i", "j")
    small = groups.mapInArrow(_scored(least), PAIR)
    if not whole.where(F.size("s") > LARGE).limit(1).count():
        return small
    return small.unionByName(_large_pairs(whole, least))


def _large_pairs(whole: DataFrame, least: float) -> DataFrame:
    """Pairs of which one set or both are large: candidates share a member of their prefixes and have fitting sizes; their
    common members are counted by joins, so no set is held whole."""
    sized = whole.select("v", "s", F.size("s").alias("n")).where(F.col("n") >= math.floor(LARGE * least))
    tokens = sized.select("v", "n", F.explode(F.slice("s", F.lit(1), prefix(least))).alias("r"))
    large = tokens.where(F.col("n") > LARGE).toDF("x", "nx", "r")
    met = large.join(tokens, "r").where((F.col("x") != F.col("v")) & ((F.col("n") <= LARGE) | (F.col("x") < F.col("v"))) & (F.least("n", "nx") >= F.greatest("n", "nx") * least - 1e-9))
    found = written(met.select("x", "nx", F.col("v").alias("y"), F.col("n").alias("ny")).distinct(), "candidates")
    members = sized.select("v", F.explode("s").alias("r"))
    both = found.join(members.toDF("x", "r"), "x").join(members.toDF("y", "r"), ["y", "r"]).groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("common"))
    jaccard = F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
    return both.where(jaccard >= least - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", jaccard.alias("jaccard"))
