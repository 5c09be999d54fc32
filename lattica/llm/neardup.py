"""Near-duplicate documents by SetSketch: banded registers propose pairs, a joint likelihood screens, full sets confirm.

A document's set is its distinct w-word shingles, as 64-bit hashes. Register i of its sketch is
floor(1 - log_b(min over the set of x_i)), with x_i exponential of rate a: a minimum on an exponential scale, truncated.
Sketches merge by maximum, and two registers are equal with a probability close to the Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, ship_package, slices
from .components import components

#: SetSketch: base, rate, 16-bit registers; bands x rows of them. At similarity 0.75 a pair shares no band with 5e-6.
BASE, RATE, BANDS, ROWS = 1.001, 20.0, 32, 4
M = BANDS * ROWS
#: A pair is dropped if no similarity from the threshold up is e^-SURE as likely as the best one.
SURE = 10.0
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Word hashes that a task remembers; members and shingles of a block; keys (8 bytes each) that may be broadcast.
MOST_WORDS, BLOCK, MOST_SHINGLES, MOST_BROADCAST = 300_000, 2048, 2_000_000, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 5, known: _Words | None = None) -> np.ndarray:
    """Sorted distinct hashes of the shingles: A-Z lowered, words cut at blanks and 09-0D; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = _Words() if known is None else known
    if len(known) > MOST_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            out = out * _STEP + h[i : len(h) - n + 1 + i]
        return np.unique(_mix(out))


def _order(j: int, keys: np.ndarray) -> np.ndarray:
    """The register that comes j-th in each element's order: a keyed bijection of 0 .. M - 1, four rounds of affine map and shift."""
    x = np.full(len(keys), j, np.uint8)
    for i in range(0, 8, 2):
        x = (x * (keys[:, i] | np.uint8(1)) + keys[:, i + 1]) & np.uint8(M - 1)
        x ^= x >> np.uint8(3)
    return x


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """M registers of each set; all 0 for an empty one. An element's x come in ascending order and stop where they can't count."""
    values = np.full((len(sets), M), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return np.zeros((len(sets), M), np.uint16)
    h = _mix(np.concatenate(sets) ^ np.uint64(0xA5A5A5A55A5A5A5A))
    keys = _mix(h ^ np.uint64(0x3C3C3C3CC3C3C3C3)).view(np.uint8).reshape(-1, 8)
    x, flat = np.zeros(len(h)), values.reshape(-1)
    with np.errstate(over="ignore"):
        for j in range(M):
            u = (_mix(h + np.uint64(j + 1) * _STEP) >> np.uint64(11)).astype(np.float64)
            x = x - np.log((u + 0.5) / float(1 << 53)) / (RATE * (M - j))
            np.minimum.at(flat, owner * M + _order(j, keys), x)
            open_ = x <= values.max(axis=1)[owner]
            if not open_.any():
                break
            if not open_.all():
                h, keys, x, owner = h[open_], keys[open_], x[open_], owner[open_]
    k = np.floor(1 - np.log(values) / np.log(BASE))
    return np.where(np.isfinite(values), np.clip(k, 0, 65535), 0).astype(np.uint16)


def _missed(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set exceeds the other's, from the share x of elements that only it has."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of similarity j given sizes n, m and in how many registers the first sketch is greater or less."""
    u = n / (n + m)
    v = 1 - u
    up, down = _missed(u - v * j), _missed(v - u * j)
    return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches may reach the threshold; pairs whose sizes rule it out never do."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    top = np.minimum(n, m) / np.maximum(n, m)
    grid = np.linspace(0, 1, 33)[None, :]
    here = lambda j: log_likelihood(j, more[:, None], less[:, None], n[:, None], m[:, None]).max(1)
    enough = here(np.minimum(threshold, top)[:, None] + grid * np.maximum(top - threshold, 0)[:, None])
    return (top >= threshold - 1e-12) & (enough >= here(grid * top[:, None]) - SURE)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _Words()
        for batch in slices(batches, "text", 2_000_000):
            sets = [shingles(x, width, known) for x in batch.column("text").to_pylist()]
            registers = sketches(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([r.astype("<u2").tobytes() for r in registers], pa.binary()),
            ], ["key", "n", "same", "sketch"])

    return released(run)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([zip_.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], ["key", "z"])


class _Block:
    """Members of a bucket: keys, shingles, parts (components so far, if known), sketches."""

    def __init__(self, keys: tuple[int, ...], sets: tuple[np.ndarray, ...], parts: tuple[int | None, ...]):
        self.keys, self.sets, self.parts = keys, sets, np.array([-1 if p is None else p for p in parts])
        self.n = np.array([len(s) for s in self.sets])
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.vocabulary, self.flat = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.sketch = sketches(list(self.sets))

    def linked(self, own: np.ndarray, sketch: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
        """Those of the rows whose sets are similar enough to a set: sketches first, then full sets."""
        if not len(rows):
            return rows
        n = np.full(len(rows), float(len(own)))
        rows = rows[likely(np.broadcast_to(sketch, (len(rows), M)), self.sketch[rows], n, self.n[rows].astype(float), percent / 100)]
        if not len(rows):
            return rows
        mark = np.zeros(len(self.vocabulary), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        mark[at[self.vocabulary[at] == own]] = True
        if len(rows) * 4 < len(self.n):
            both = np.array([np.count_nonzero(mark[self.flat[self.starts[r] : self.starts[r + 1]]]) for r in rows])
        else:
            both = np.add.reduceat(mark[self.flat].astype(np.int64), self.starts[:-1])[rows]
        return rows[100 * both >= percent * (len(own) + self.n[rows] - both)]


def _inside(block: _Block, percent: int) -> Iterator[tuple[int, int]]:
    """A forest of a block's links. Each member in turn meets the later ones that aren't in its component yet: a tight
    group costs one row of comparisons, and only documents that aren't alike cost all pairs, of which none becomes a row."""
    part = np.arange(len(block.n))
    for i in range(len(block.n) - 1):
        if (part == part[0]).all():
            return
        later = np.arange(i + 1, len(block.n))
        for j in block.linked(block.sets[i], block.sketch[i], later[part[later] != part[i]], percent).tolist():
            if part[i] != part[j]:
                yield block.keys[i], block.keys[j]
                part[part == part[j]] = part[i]


def _visit(block: _Block, key: int, part: int, own: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A link of a visitor to each other part that it reaches in a block."""
    rows = block.linked(own, sketches([own])[0], np.flatnonzero(block.parts != part), percent)
    for j in np.unique(block.parts[rows], return_index=True)[1]:
        yield key, block.keys[rows[j]]


def _examine(width: int, percent: int, visits: bool):
    """Links from rows by (band, salt): those inside each block (kind 0), or those of visitors (kind 1) to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, known = zstandard.ZstdDecompressor(), _Words()
        at, held, block, found = None, [], None, []
        for batch in batches:
            for band, salt, kind, key, part, z in zip(*(batch.column(c).to_pylist() for c in ("band", "salt", "kind", "key", "part", "z")), strict=True):
                if (band, salt) != at:
                    if held and not visits:
                        found += _inside(_Block(*zip(*held, strict=True)), percent)
                    at, held, block = (band, salt), [], None
                own = shingles(unzip.decompress(z).decode(), width, known)
                if kind == 0:
                    held.append((key, own, part))
                elif held:
                    block = block or _Block(*zip(*held, strict=True))
                    found += _visit(block, key, part, own, percent)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if held and not visits:
            found += _inside(_Block(*zip(*held, strict=True)), percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return released(run)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, most: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id, kept of each row; two documents are linked if 100 * |A n B| >= percent * |A u B|.

    component_id is the smallest key that a row reaches over links, itself included; kept says that it is the row's
    own. Texts without words and null texts have an empty set and no links. Equal sets are one vertex, so copies cost
    nothing beyond their sketch; rows that share a key are one vertex too, and a row without a key gets its set's
    component or null. Other columns are ignored; an empty table gives no rows. A very long text is sketched and compared
    whole, by tasks that hold its shingles' hashes.

    Distinct sets that share a band meet in its bucket (buckets of the same members are one). Buckets are cut into
    blocks of at most `most` members or MOST_SHINGLES shingles, each with the bucket's smallest key; a block is
    examined whole. Where a bucket has several blocks, members outside its largest component then visit the other
    blocks. So every pair that shares a band is confirmed, refuted or already in one component, and only links become rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketched = materialise(base.mapInArrow(_sketch(width), "key long, n long, same binary, sketch binary"), "sketches")
    sets = sketched.where("n > 0").groupBy("same").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = materialise(sets.where("key is not null"), "sets")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * ROWS * 2 + 1, ROWS * 2)) for i in range(BANDS)])
    rows = sets.select("key", "n", F.explode(bands).alias("band"))
    shared = rows.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("last"), F.bit_xor(F.xxhash64("key")).alias("mark"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    shared = shared.groupBy("centre", "last", "mark", "size", "shingles").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("shingles") / MOST_SHINGLES)).cast("long")
    shared = materialise(shared.select("band", "centre", blocks.alias("blocks")), "buckets")
    members = materialise(rows.select("band", "key").join(shared, "band"), "members")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("long")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    texts = materialise(_only(base, members.select("key").distinct()).mapInArrow(_packed, "key long, z binary"), "texts")

    def examined(placed: DataFrame, visits: bool) -> DataFrame:
        dealt = placed.join(texts, "key").repartition("band", "salt").sortWithinPartitions("band", "salt", "kind")
        return materialise(dealt.mapInArrow(_examine(width, percent, visits), "a long, b long"), "links")

    placed = members.select("band", "key", F.explode(F.when(F.col("key") == F.col("centre"), everywhere).otherwise(F.array(own))).alias("salt"))
    links = examined(placed.select("band", "salt", F.lit(0).alias("kind"), "key", F.lit(None).cast("long").alias("part")), False)
    labels = components(links)
    cut = members.where("blocks > 1")
    if not cut.isEmpty():
        named = materialise(cut.join(labels.withColumnRenamed("v", "key"), "key", "left").select("band", "key", "blocks", F.coalesce("component", "key").alias("part")), "named")
        parts = named.groupBy("band", "part").agg(F.count("*").alias("rows")).groupBy("band").agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        named = named.join(parts.select("band", "main"), "band")
        residents = named.select("band", own.alias("salt"), F.lit(0).alias("kind"), "key", "part")
        visitors = named.where("part != main").select("band", F.explode(everywhere).alias("salt"), F.lit(1).alias("kind"), "key", "part")
        links = links.unionByName(examined(residents.unionByName(visitors), True))
        labels = components(links)
    named = sets.select("same", "key").join(labels.withColumnRenamed("v", "key"), "key", "left").select("same", F.coalesce("component", "key").alias("component"))
    out = sketched.select("key", "n", "same").join(named, "same", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the keys; texts are shuffled only where there are too many keys to broadcast."""
    keys = materialise(keys, "keys")
    return docs.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "key", "left_semi")
