"""The prefix trie of conversations: which beginnings they share, and what sharing them saves.

Smallest-member ownership: a node belongs to the smallest conversation that passes through it. Whoever owns a node owns
all nodes below it on its own path, so a conversation owns a suffix of its path (or nothing), and one number per
conversation, the depth where that suffix begins, says what it owns. What a subtree saves is then, over its members, the
tokens of their paths from there down less those of the nodes they own: one sum by prefix, with no walk over the trie.

Windows run along a conversation's path only (running keys, tokens down to the end). Nodes are aggregates, never
windows, so a node that a third of all conversations pass through is summed before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, released, ship_package

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose base is the same, original turns that a base lends at most (one less), and ids in a block of a node's list.
BLOCK_OF, LENDS, IDS = 20, 4, 4096
#: A node with more than this part of all links to parents is joined by broadcast; there are at most so many.
HEAVY = 1024
KEY = ("depth", "k1", "k2")


def crc32_of(key: Column) -> Column:
    """The unsigned CRC-32 of a key's decimal text."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8"))


def steps(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, words: a row per turn, in its conversation's order.

    Rows go by turn (null first), then role, then text; a null role or text is empty; repeated rows are turns of their
    own. Rows without a conversation id belong to none and are left out. A digest is the SHA-256 of role and text, with
    the role's length before them, so that equal digests mean equal turns. Texts end here: a conversation of any length
    is sorted by one task, which spills, and what goes on has some 60 bytes a turn.
    """
    said = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return said.select("conv", F.row_number().over(order).cast("long").alias("pos"), F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(own: DataFrame, block: int = BLOCK_OF, lends: int = LENDS) -> tuple[DataFrame, DataFrame]:
    """(convs(conv), paths(conv, depth, digest, words)) of steps, where conversation c begins like conversation c - c % block.

    c takes the first h = crc32(c) % lends turns of that base (all if it has fewer, none if there is no base), then its own
    turns after its first h. A base is joined with the ids of its block, so with a bounded number of rows.
    """
    lent = (crc32_of(F.col("conv")) % lends).cast("long")
    convs = own.select("conv").distinct().select("conv", lent.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    heads = own.where((F.col("conv") % block == 0) & (F.col("pos") < lends)).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "words")
    known = heads.groupBy("base").agg(F.max("pos").alias("has"))
    begins = convs.join(known, "base", "left").select("conv", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("takes"))
    rest = own.join(begins, "conv").where("pos > h").select("conv", (F.col("takes") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    return convs.select("conv"), borrowed.unionByName(rest)


def _paths(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's nodes, the root at depth 0 included: key (depth, k1, k2), its parent's (p1, p2), the tokens from
    here to the end of the path, and whether it is the end. A key is a running xor of 128 bits of (depth, digest)."""
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    path = Window.partitionBy("conv").orderBy("depth")
    down = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    key = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "digest")).over(path.rowsBetween(Window.unboundedPreceding, 0))
    keyed = root.unionByName(rows).select("conv", "depth", "digest", "words", key(1).alias("k1"), key(2).alias("k2"), F.sum("words").over(down).alias("tail"))
    return keyed.select("*", F.lag("k1").over(path).alias("p1"), F.lag("k2").over(path).alias("p2"), F.lead("depth").over(path).isNull().alias("ends"))


def _nodes(paths: DataFrame) -> DataFrame:
    """depth, k1, k2, p1, p2, owner, tail (of the owner's path), n_convs, n_ends. Members of a node must agree on parent and
    last turn, level by level, which makes equal keys equal beginnings; if a key ever joined others, the job stops."""
    turn = F.struct("p1", "p2", "digest")
    found = paths.groupBy(*KEY).agg(F.min(F.struct("conv", "tail")).alias("own"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min(turn).alias("turn"), F.max(turn).alias("last"))
    sure = F.when(F.col("turn").eqNullSafe(F.col("last")), F.col("turn")).otherwise(F.raise_error(F.lit("two beginnings share a key")).cast("struct<p1:bigint,p2:bigint,digest:binary>"))
    return found.withColumn("turn", sure).select(*KEY, "turn.p1", "turn.p2", F.col("own.conv").alias("owner"), F.col("own.tail").alias("tail"), "n_convs", "n_ends")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv) to blocks of at most IDS ids: k1, k2, first, ids."""
    at, ids = None, []

    def block() -> list:
        return [*at, ids[0], ",".join(map(str, ids))]

    for batch in batches:
        out = []
        for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != at or len(ids) == IDS:
                if ids:
                    out.append(block())
                at, ids = (k1, k2), []
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["k1", "k2", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in block()], ["k1", "k2", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to k1, k2, ends_sha256: a list of any length passes through the hash block by block."""
    at, running = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == at:
                running.update(b"," + ids.encode())
                continue
            if at:
                out.append((*at, running.hexdigest()))
            at, running = (k1, k2), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["k1", "k2", "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, running.hexdigest())], ["k1", "k2", "ends_sha256"])


def end_lists(paths: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of nodes where a conversation ends: ids ascending, joined by commas. The ids of a node that many
    conversations end at lie in several ranges; each range joins its own, and one task hashes the blocks in order."""
    ship_package(paths.sparkSession)
    ends = paths.where("ends").select("k1", "k2", "conv")
    blocks = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(released(_lists), "k1 long, k2 long, first long, ids string")
    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(released(_hashes), "k1 long, k2 long, ends_sha256 string")


def _with_parents(links: DataFrame, nodes: DataFrame, children: DataFrame) -> DataFrame:
    """links(owner, depth, p1, p2) with the parents' owner. Parents with over 1 / HEAVY of all children, at most HEAVY of
    them, are broadcast; the other parents have few links each and are joined by a shuffle."""
    total = nodes.count()
    parents = children.join(nodes, list(KEY)).select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent"), (F.col("n_children") * HEAVY > total).alias("heavy"))
    parents = materialise(parents, "parents")
    heavy, light = F.broadcast(parents.where("heavy").drop("heavy")), parents.where("not heavy").drop("heavy")
    links = links.withColumn("up", F.col("depth") - 1)
    few = links.join(heavy.select("up", "p1", "p2"), ["up", "p1", "p2"], "left_anti").join(light, ["up", "p1", "p2"])
    return links.join(heavy, ["up", "p1", "p2"]).unionByName(few).select("owner", "depth", "parent")


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of the trie of paths(conv, depth from 1, digest, words): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    `convs` names all conversations once; those without rows are members of the root alone. Depths of a conversation are
    1, 2, ... without gaps. A conversation that repeats another owns nothing. Without conversations there are no nodes.
    """
    paths = materialise(_paths(convs, rows), "paths")
    nodes = materialise(_nodes(paths), "nodes")
    leaf = F.max(F.struct("depth", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf")))["leaf"]
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "tail", "p1", "p2")).alias("first"), leaf.alias("leaf")).select("owner", "first.*", "leaf")
    owned = materialise(owned, "owned")
    # a member's part of a subtree: its tokens from the node down, less those from where its own nodes begin
    marks = owned.select(F.col("owner").alias("conv"), F.col("depth").alias("begins"), F.col("tail").alias("kept"), "leaf")
    part = F.when(F.col("depth") >= F.col("begins"), 0).otherwise(F.col("tail") - F.coalesce("kept", F.lit(0)))
    members = paths.join(marks, "conv", "left").select(*KEY, part.cast("long").alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = members.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    # only where a conversation's own nodes begin does the parent belong to another
    above = _with_parents(owned.where("depth > 0").select("owner", "depth", "p1", "p2"), nodes, children)
    named = nodes.join(above.withColumnRenamed("depth", "begins"), "owner", "left").withColumn("parent_conv_id", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("begins"), F.col("parent")).otherwise(F.col("owner")))
    whole = named.join(sums, list(KEY)).join(children, list(KEY), "left").join(end_lists(paths), ["k1", "k2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame, **names) -> DataFrame:
    """The trie of the conversations that begin like the base of their block; see `steps`, `rebuilt` and `prefix_trie`."""
    own = materialise(steps(turns, **names), "steps")
    return prefix_trie(*rebuilt(own))
