"""Token-ID shards in training order: a keyed Feistel permutation gives every sequence its slot.

Documents are encoded, ended by a mark, strung together per input partition and cut into sequences of a fixed length.
Sequence i of N gets slot P(i), P a Feistel network on the next even number of bits that walks its cycles until it is
back below N. Ranges of slots are shards: slot s is at byte (s mod per_shard) * stride of shard s // per_shard, so a
reader can start at any slot and read on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import materialise, open_store, ship_package, slices

#: Tokens of a sequence, sequences of a shard, Feistel rounds; what fills up a partition's last sequence.
LENGTH, PER_SHARD, ROUNDS, FILL = 2048, 4096, 6, 65535
#: Tasks that read shards at most.
MOST_READERS = 10_000


def _round(x: np.ndarray, key: int, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x ^ np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """P(index), a permutation of 0 .. n - 1 that the key picks."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(index, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, i) & mask)
        out = out.copy()
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _tokens(ranks: dict[bytes, int]):
    """Lists of ids of the texts of each batch."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[list[int]]]:
        for batch in slices(batches, "text"):
            yield (encoding.encode_ordinary(x or "") for x in batch.column("text").to_pylist())

    return run


def write_shards(docs: DataFrame, path: str, ranks_path: str, key: int = 20240229, text: str = "text", end: int = 50256, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes shards under `path` (a URI that pyarrow opens) and returns a row per shard: shard, first_slot, sequences, n_tokens, sha256, uri.

    Null and empty texts are a lone end mark; the last sequence of an input partition is filled up with FILL, which
    n_tokens doesn't count. An empty table gives no shards. Input partitions must come out alike each time, as those of
    written tables do: they are encoded once to count and once to write, which the second pass verifies. Rows may
    repeat, other columns are ignored. A very long text is encoded whole by one task and fills many sequences. A shard is written under a name of its attempt and then renamed, so a task may
    run twice.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    texts = docs.select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(len(x) + 1 for found in _tokens(ranks.value)(batches) for x in found)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64())], ["part", "tokens"])

    totals = {r.part: r.tokens for r in texts.mapInArrow(count, "part long, tokens long").collect()}  # a row per partition
    first, n = {}, 0
    for part in sorted(totals):
        first[part] = n
        n += -(-totals[part] // length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mark = TaskContext.get().partitionId(), np.array([end], np.uint16)
        at, seen, rest = first.get(part, 0), 0, np.empty(0, np.uint16)
        for found in _tokens(ranks.value)(batches):
            tokens = np.concatenate([part for x in found for part in (np.fromiter(x, np.uint16, len(x)), mark)])
            seen += len(tokens)
            rest = np.concatenate([rest, tokens])
            whole = len(rest) // length
            if whole:
                yield packed(at, rest[: whole * length], whole * length)
                at, rest = at + whole, rest[whole * length :]
        if len(rest):
            yield packed(at, np.concatenate([rest, np.full(length - len(rest), FILL, np.uint16)]), len(rest))
        if seen != totals.get(part, 0):
            raise ValueError("an input partition changed between two passes; write the input as a table first")

    def packed(at: int, tokens: np.ndarray, real: int) -> pa.RecordBatch:
        own = slots(np.arange(at, at + len(tokens) // length), n, key)
        sizes = np.minimum(length, real - np.arange(len(own)) * length)
        data = tokens.astype("<u2").tobytes()
        rows = [data[i * 2 * length : (i + 1) * 2 * length] for i in range(len(own))]
        return pa.RecordBatch.from_arrays([pa.array(own // per_shard), pa.array(own), pa.array(sizes.astype(np.int64)), pa.array(rows, pa.binary())], ["shard", "slot", "n_tokens", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        now = None
        for batch in batches:
            for shard, slot, n_tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "n_tokens", "ids")), strict=True):
                if now is None or now["shard"] != shard:
                    if now is not None:
                        yield closed(store, root, now)
                    name = f"{root}/.shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
                    now = {"shard": shard, "first_slot": slot, "sequences": 0, "n_tokens": 0, "hash": hashlib.sha256(), "name": name, "out": store.open_output_stream(name)}
                now["out"].write(ids)
                now["hash"].update(ids)
                now["sequences"] += 1
                now["n_tokens"] += n_tokens
        if now is not None:
            yield closed(store, root, now)

    def closed(store, root: str, now: dict) -> pa.RecordBatch:
        now["out"].close()
        store.move(now["name"], f"{root}/shard-{now['shard']:08d}.bin")
        uri = f"{path.rstrip('/')}/shard-{now['shard']:08d}.bin"
        return pa.RecordBatch.from_pylist([{"shard": now["shard"], "first_slot": now["first_slot"], "sequences": now["sequences"], "n_tokens": now["n_tokens"], "sha256": now["hash"].hexdigest(), "uri": uri}], _SHARDS)

    rows = texts.mapInArrow(cut, "shard long, slot long, n_tokens long, ids binary")
    dealt = rows.repartition("shard").sortWithinPartitions("slot")
    return materialise(dealt.mapInArrow(write, "shard long, first_slot long, sequences long, n_tokens long, sha256 string, uri string"), "shards")


_SHARDS = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("sequences", pa.int64()), ("n_tokens", pa.int64()), ("sha256", pa.string()), ("uri", pa.string())])


def read_sequences(shards: DataFrame, start: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """slot, shard, n_tokens, ids_sha256 and, if asked for, ids of every sequence from slot `start` on, read from the shards in order.

    n_tokens leaves out what fills a sequence up; ids hold it.
    """
    ship_package(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, count, uri in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_slot", "sequences", "uri")), strict=True):
                store, file = open_store(uri)
                skip = max(0, start - first)
                with store.open_input_file(file) as raw:
                    raw.seek(skip * 2 * length)
                    for at in range(skip, count, 512):
                        data = raw.read(min(512, count - at) * 2 * length)
                        ids = np.frombuffer(data, "<u2").reshape(-1, length)
                        sizes = (ids != FILL).sum(1)
                        columns = [pa.array(np.arange(first + at, first + at + len(ids))), pa.array(np.full(len(ids), shard)), pa.array(sizes.astype(np.int64)), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids])]
                        names = ["slot", "shard", "n_tokens", "ids_sha256"]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)

    found = shards.where(F.col("first_slot") + F.col("sequences") > start).select("shard", "first_slot", "sequences", "uri")
    return found.repartition(max(1, min(MOST_READERS, found.count())), "shard").mapInArrow(run, "slot long, shard long, n_tokens long, ids_sha256 string" + ", ids array<int>" * with_ids)


def shard_round_trip(docs: DataFrame, path: str, ranks_path: str, **options) -> DataFrame:
    """Writes the shards and reads every sequence back."""
    return read_sequences(write_shards(docs, path, ranks_path, **options), length=options.get("length", LENGTH))

