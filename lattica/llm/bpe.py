"""Byte-level BPE: a DuckDB recursive query per partition contracts pairs to the fixpoint; ordered aggregation decodes.

Rows (word, position, token) join the merge table. Each round contracts each word's minimum-rank pair at its leftmost
place. Exact short cuts save rounds: a word is cut where no vocabulary entry can lie across two bytes (no merge can),
equal segments are solved once, and long ones are solved in overlapping windows, joined at tokens that both share, so
that time grows in proportion to a word's length.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence, Sized
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship_package, slices
from .token_counts import WHITE

#: The split of GPT-2, with White_Space spelled out: `regex` also counts 1C to 1F as \s.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
#: Encoded words after which a task's table goes back to its first KEPT; results don't depend on it.
MOST_KNOWN = 300_000
#: Of these, the first, which are the commonest; they stay for the worker's next task, too.
KEPT = 200_000
#: Segments (of at most WINDOW bytes) whose ids a worker remembers, for words that share them; results don't depend on it.
MOST_SOLVED = 200_000

#: Bytes of a window. Longer segments are solved in windows that overlap by half; results don't depend on it.
WINDOW = 64
#: Bytes of text whose words are lists at once, bytes that one recursive query contracts, and ids that one decoding query
#: holds: with the words that stay, what a worker's memory depends on.
SLICE, CONTRACTED, DECODED = 750_000, 1_000_000, 200_000

#: Unnested token-position rows join the merge table, and each list loses its leftmost minimum-rank pair, to the fixpoint.
#: USING KEY keeps the last list of each segment only.
_ROUNDS = """
WITH RECURSIVE step(w, toks, fin) USING KEY (w) AS (
  SELECT w, toks, false FROM init
  UNION
  (WITH pair AS (
     SELECT w, unnest(toks) AS a, unnest(toks[2:]) AS b, generate_subscripts(toks, 1) AS pos FROM step WHERE NOT fin),
   best AS (
     SELECT p.w, min(m.m * 4294967296 + p.pos) AS k FROM pair p JOIN merges m ON m.lr = p.a * 65536 + p.b GROUP BY p.w)
   SELECT s.w, CASE WHEN k IS NULL THEN toks ELSE toks[:(k % 4294967296) - 1] || [k // 4294967296] || toks[(k % 4294967296) + 2:] END, k IS NULL
   FROM step s LEFT JOIN best b ON b.w = s.w WHERE NOT s.fin))
SELECT w, toks AS ids FROM step ORDER BY w
"""

#: Bytes are held as the characters of these numbers.
_DECODE = """
SELECT part, array_to_string(list(t.bytes ORDER BY g.pos), '') AS bytes, bool_or(t.m IS NULL) AS unknown
FROM given g LEFT JOIN tokens t ON t.m = g.id GROUP BY part ORDER BY part
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def words_of(text: str) -> list[str]:
    """The text cut before each blank that follows a non-blank; no match of PATTERN crosses such a place."""
    parts = text.split(" ")
    out, open_ = [parts[0]], parts[0] == "" or parts[0][-1] in _BLANK
    for x in parts[1:]:
        if open_:
            out[-1] += " " + x
        else:
            out.append(" " + x)
        open_ = x == "" or x[-1] in _BLANK
    return out if out != [""] else []


#: Bits of the tables of byte runs. Two runs that share an entry only leave a word uncut.
_BITS = 22


def _runs(a: np.ndarray, n: int) -> np.ndarray:
    """A table index for each run of n bytes."""
    h = np.zeros(max(0, len(a) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h * np.uint64(256) + a[i : len(a) - n + 1 + i].astype(np.uint64)) if len(h) else h
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Encoder:
    """Encodes distinct words of texts, remembers their ids (little-endian uint32), and decodes lists of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.ids, self.solved = ranks, {}, {}
        order = sorted(ranks.values())
        if order[-1] >= 1 << 16:
            raise ValueError("pair keys hold ids below 65,536")
        left, right, merged = [], [], []
        self.whole = [np.zeros(1 << _BITS, bool) for _ in range(2)]  # entries of two and of three bytes
        self.inside = np.zeros(1 << _BITS, bool)  # four bytes somewhere in an entry
        for token, rank in ranks.items():
            a = np.frombuffer(token, np.uint8).astype(np.int64)
            if len(a) in (2, 3):
                self.whole[len(a) - 2][_runs(a, len(a))] = True
            elif len(a) > 3:
                self.inside[_runs(a, 4)] = True
            for at in range(1, len(token)):
                if (x := ranks.get(token[:at])) is not None and (y := ranks.get(token[at:])) is not None:
                    left.append(x), right.append(y), merged.append(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.lengths = np.zeros(order[-1] + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        back = {r: t for t, r in ranks.items()}
        tokens = pa.table({"m": pa.array(order, pa.int64()), "bytes": [back[i].decode("latin-1") for i in order]})
        lr = np.array(left, np.int64) * 65536 + np.array(right, np.int64)
        self.tables = {"tokens": tokens, "merges": pa.table({"lr": lr, "m": np.array(merged, np.int64)})}
        self.open()

    def open(self) -> Encoder:
        """Starts a database with the tables; a task closes it again, since workers outlive tasks. It writes no files."""
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, table in self.tables.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        return self

    def close(self) -> None:
        self.db.close()
        self.ids = dict(islice(self.ids.items(), KEPT))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces (matches of PATTERN)."""
        raw = [p.encode() for p in pieces]
        out = [b"" if (rank := self.ranks.get(b)) is None else rank.to_bytes(4, "little") for b in raw]
        for part in _bounded([i for i, x in enumerate(out) if not x], raw):
            self._contract(part, raw, out)
        return out

    def _cuts(self, flat: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where segments start: no merge crosses the other places. A merge across two bytes makes an entry that is just
        these, or three bytes with them, or holds four bytes in a row with them."""
        crossed = np.zeros(len(flat) + 3, bool)
        for n, table in ((2, self.whole[0]), (3, self.whole[1]), (4, self.inside)):
            if len(flat) >= n:
                hit = table[_runs(flat, n)] & (word[: len(flat) - n + 1] == word[n - 1 :])
                for i in range(n - 1):
                    crossed[i + 1 : i + 1 + len(hit)] |= hit
        return ~crossed[: len(flat)]

    def _contract(self, part: list[int], raw: list[bytes], out: list[bytes]) -> None:
        data = b"".join([raw[i] for i in part])
        flat = np.frombuffer(data, np.uint8)
        word = np.repeat(np.arange(len(part)), [len(raw[i]) for i in part])
        at = np.flatnonzero(self._cuts(flat, word))
        owner, ends = word[at], [*at.tolist(), len(data)]
        segments = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        distinct = dict.fromkeys(segments)
        long = [x for x in distinct if len(x) > WINDOW]
        wanted = dict.fromkeys([x for x in distinct if len(x) <= WINDOW] + [x[a : a + WINDOW] for x in long for a in _grid(len(x))])
        solved = {x: ids for x in wanted if (ids := self.solved.get(x)) is not None}
        self._solve([*wanted], solved)
        if len(self.solved) < MOST_SOLVED:
            self.solved.update(islice(solved.items(), MOST_SOLVED - len(self.solved)))
        whole = {x: self._stitched(x, solved) for x in long}
        firsts = [*np.flatnonzero(np.diff(owner, prepend=-1)).tolist(), len(segments)]
        for i, a, b in zip(part, firsts, firsts[1:], strict=False):
            out[i] = b"".join([solved[x] if len(x) <= WINDOW else whole[x] for x in segments[a:b]])

    def _solve(self, segments: list[bytes], solved: dict[bytes, bytes]) -> None:
        """Adds the ids of each segment that isn't there, by the rounds."""
        fresh = [x for x in dict.fromkeys(segments) if x not in solved]
        for part in _bounded(range(len(fresh)), fresh):
            given = fresh[part[0] : part[-1] + 1]
            tokens = self.byte_ids[np.frombuffer(b"".join(given), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(list(map(len, given)))])
            init = pa.table({"w": np.arange(len(given)), "toks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))})
            self.db.register("init", init)
            lists = self.db.sql(_ROUNDS).to_arrow_table().combine_chunks()["ids"].chunk(0)
            self.db.unregister("init")
            values, ends = np.asarray(lists.values).astype("<u4").tobytes(), np.asarray(lists.offsets).tolist()
            solved.update((x, values[4 * a : 4 * b]) for x, a, b in zip(given, ends, ends[1:], strict=False))

    def _stitched(self, segment: bytes, solved: dict[bytes, bytes]) -> bytes:
        """The ids of a long segment from those of its windows.

        Two windows that share a token (same bytes, same place) are joined there. That is exact whatever the ranks: if
        each two neighbours of a token sequence are the encoding of their bytes, then no merge can be the first to cross
        a boundary between them, so the whole is the encoding of its bytes; and any stretch of an encoding is one.
        Where the windows share none, as in a run whose period doesn't divide the grid, the next window starts at a
        boundary of what is joined already, and grows until they do.
        """
        ids: list[int] = []
        starts: list[int] = []
        end = 0

        def join(a: int, size: int) -> bool:
            nonlocal end
            piece = segment[a : a + size]
            if piece not in solved:
                self._solve([piece], solved)
            new = np.frombuffer(solved[piece], "<u4")
            lengths = self.lengths[new]
            at, new = (a + np.cumsum(lengths) - lengths).tolist(), new.tolist()
            if a == 0:
                ids[:], starts[:], end = new, at, len(piece)
                return True
            there = dict(zip(at, range(len(at)), strict=True))
            for j in range(bisect_left(starts, a), len(starts)):
                if (i := there.get(starts[j])) is not None and new[i] == ids[j]:
                    ids[j:], starts[j:], end = new[i:], at[i:], a + len(piece)
                    return True
            return False

        for a in _grid(len(segment)):
            while end < min(a + WINDOW, len(segment)) and not join(a, WINDOW):
                size = WINDOW
                while (own := starts[max(0, bisect_left(starts, end - size // 2 + 1) - 1)]) + size <= end or not join(own, size):
                    size *= 2
        return np.array(ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        cut = list(map(PATTERN.findall, words))
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.pieces(distinct), strict=True))
        self.ids.update([(w, ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))) for w, c in zip(words, cut, strict=True)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.ids) > MOST_KNOWN:
            self.ids = dict(islice(self.ids.items(), KEPT))
        cut = list(map(words_of, texts))
        self.learn(list(set(chain.from_iterable(cut)).difference(self.ids)))
        return [b"".join(map(self.ids.__getitem__, c)) for c in cut]

    def decode(self, lists: list[np.ndarray]) -> Iterator[Iterator[bytes | None]]:
        """The bytes of each list of ids, in parts: ordered aggregation over (list, position, id); None for an unknown id."""
        parts = [[x[a : a + DECODED] for a in range(0, len(x), DECODED)] for x in lists]
        found = self._decoded(list(chain.from_iterable(parts)))
        for p in parts:
            yield islice(found, len(p))

    def _decoded(self, parts: list[np.ndarray]) -> Iterator[bytes | None]:
        for group in _bounded(range(len(parts)), parts, DECODED):
            ids = [parts[i] for i in group]
            sizes = np.array(list(map(len, ids)))
            place = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
            self.db.register("given", pa.table({"part": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": place, "id": np.concatenate(ids).astype(np.int64)}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("given")
            for text, unknown in zip(got["bytes"].to_pylist(), got["unknown"].to_pylist(), strict=True):
                yield None if unknown else text.encode("latin-1")


def _grid(size: int) -> range:
    """Where the windows of a segment start."""
    return range(0, max(1, size - WINDOW // 2), WINDOW // 2)


def _bounded(rows: Iterable[int], items: Sequence[Sized], most: int = CONTRACTED) -> Iterator[list[int]]:
    """Cuts a list of row numbers where the lengths of their items pass a bound."""
    part, size = [], 0
    for i in rows:
        part.append(i)
        size += len(items[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_encoders: dict[int, Encoder] = {}


def encoder(ranks: dict[bytes, int]) -> Encoder:
    """A worker process keeps the tables and the commonest words of one encoder."""
    key = hash(frozenset(ranks.items()))
    if key in _encoders:
        return _encoders[key].open()
    _encoders.clear()
    _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _encode(ranks, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value)
        for batch in slices(batches, "text", SLICE):
            raw = own.encode([x or "" for x in batch.column("text").to_pylist()])
            ids = [np.frombuffer(x, "<u4") for x in raw]
            decoded = []
            for parts in own.decode(ids):
                seen = hashlib.sha256()
                for part in parts:
                    seen.update(part)
                decoded.append(seen.hexdigest())
            n, ids_hash = [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in raw]
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        own.close()

    return released(run)


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each whole text; no special tokens.

    decoded_sha256 digests the bytes that the row's list of ids decodes to. A null text is empty: no tokens, the digests
    of nothing. A null key stays null, repeated rows are encoded one by one, other columns are ignored. One pass without
    a shuffle; the rank file is broadcast (its size is the bound). A very long text is encoded by one task, in time in
    proportion to its length, also where it is one word; the task holds it, its words and its ids.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode(ranks, with_ids), schema).withColumnRenamed("key", key)


def _decode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value)
        for batch in batches:
            out = []
            for parts in own.decode([np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]):
                got = list(parts)
                out.append(None if None in got else b"".join(got))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "decoded"])
        own.close()

    return released(run)


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded bytes of each list of ids: empty for no ids or a null list, null where an id is unknown."""
    spark = tokens.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = dict(tokens.dtypes)[key]
    return tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(_decode(ranks), f"key {kind}, decoded binary").withColumnRenamed("key", key)
