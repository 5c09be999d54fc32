"""Document fingerprints: a canonical exact digest, and classes of equal documents confirmed byte by byte.

Canonical form: NFKC, case folded, white space runs as one blank. Its 128-bit xxh3 digest is the fingerprint. Classes are
the groups of (digest, canonical bytes): Spark compares the bytes inside a bucket of equal digests, so two documents
whose digests collide stay apart. Texts travel compressed; equal bytes give equal compressed bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package, slices

_LOWEST = -(1 << 63)
#: Repeated digests (some 50 bytes each) up to which they are broadcast.
MOST_BROADCAST = 500_000
#: Ranges of keys at most; their bounds and first keys are known to all tasks.
MOST_RANGES = 10_000


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canonical_bytes: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical_bytes)


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by as many (or all) of the following text's first ones."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _zip():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


def _unzip(z: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z).decode()


def _forms(with_form: bool, fingerprint: Callable[[bytes], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = _zip()
        for batch in slices(batches, "text"):
            forms = [canonical(x or "") for x in batch.column("text").to_pylist()]
            columns, names = [batch.column("key"), pa.array([fingerprint(x) for x in forms], pa.string())], ["key", "fingerprint"]
            if with_form:
                columns += [pa.array([hashlib.sha256(x).digest() for x in forms], pa.binary()), pa.array([zip_.compress(x) for x in forms], pa.binary())]
                names += ["check", "form"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: Callable[[bytes], str] = digest) -> DataFrame:
    """fingerprint, check, class_id: a row per canonical text that several rows may have; class_id is its smallest key.

    Digests are counted first; only texts whose digest repeats can be equal to another, and only they are shuffled and
    compared. Where such digests are too many to broadcast, all texts are compared. `check` is the SHA-256 of the
    canonical bytes, which tells colliding digests apart in joins. Null texts are empty. Copies are merged before the
    shuffle, so a hot group is one row per task.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_forms(False, fingerprint), "key long, fingerprint string").groupBy("fingerprint").agg(F.count("*").alias("n"))
    repeated = materialise(counts.where("n > 1").select("fingerprint"), "repeated")
    forms = rows.mapInArrow(_forms(True, fingerprint), "key long, fingerprint string, check binary, form binary")
    if repeated.count() <= MOST_BROADCAST:
        forms = forms.join(F.broadcast(repeated), "fingerprint", "left_semi")
    return forms.groupBy("fingerprint", "check", "form").agg(F.min("key").alias("class_id")).select("fingerprint", "check", "class_id")


def _buckets(bounds: np.ndarray, keys: np.ndarray, spread: pa.Array) -> np.ndarray:
    """The range of each key; null keys, which come last, have ranges of their own below 0, by a hash of the text."""
    return np.where(keys == _LOWEST, -1 - spread.to_numpy(zero_copy_only=False), np.searchsorted(bounds, keys, side="left"))


def _bucketed(bounds: np.ndarray, guests: dict[int, int], heads: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = _zip()
        for batch in slices(batches, "text"):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            buckets = _buckets(bounds, keys, batch.column("spread"))
            texts = [zip_.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            rows = [(int(b), False, int(k), z) for b, k, z in zip(buckets, keys, texts, strict=True)]
            rows += [(guests[b], True, k, z) for b, _, k, z in rows if heads[b] == k]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "guest", "key", "z"), r, strict=True)) for r in rows], _BUCKETED)

    return run


_BUCKETED = pa.schema([("bucket", pa.int64()), ("guest", pa.bool_()), ("key", pa.int64()), ("z", pa.binary())])
_COMPARED = pa.schema([
    ("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("check", pa.binary()),
])


def _comparing(fingerprint: Callable[[bytes], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket, guests last, descending key, ties by bytes: the next row of a bucket is the next document."""
        last, out = None, []
        for batch in batches:
            for bucket, guest, key, z in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "key", "z")), strict=True):
                here = None
                if last is not None and last[0] == bucket:
                    text = _unzip(z)
                    here = (text, canonical(text))
                    out.append(_row(last[1], last[2], here, fingerprint))
                if guest:
                    last = None
                    continue
                if here is None:
                    text = _unzip(z)
                    here = (text, canonical(text))
                last = (bucket, key, here)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, _COMPARED)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _COMPARED)

    return run


def _row(key: int, own: tuple[str, bytes], following: tuple[str, bytes], fingerprint: Callable[[bytes], str]) -> dict:
    text, form = own
    changed = edited(text, following[0])
    other = canonical(changed)
    return {
        "key": None if key == _LOWEST else key, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": fingerprint(form), "edited_fingerprint": fingerprint(other), "near_edited": float(form == other), "near_next": float(form == following[1]),
        "check": hashlib.sha256(form).digest(),
    }


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: Callable[[bytes], str] = digest) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and the likeness of the digests: 1 if the canonical bytes are equal, else 0.

    The next document is the one with the next smaller key; after the last comes the first, and a single document
    follows itself. Null texts are empty. Rows that share a key follow each other by the bytes of their compressed texts; null
    keys come last, dealt over ranges by a hash of their texts. A very long text is held by one task, with its neighbour.
    Keys are cut at approximate quantiles into at most MOST_RANGES ranges, the first row of a range is also sent to the end of the range
    before it, and each range is read in order: one shuffle, no window, no range in one task that another could share.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("key"), F.col(text).alias("text"))
    n = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.when(F.col("key") == _LOWEST, F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(0)
    keyed = keyed.withColumn("spread", spread.cast("long"))
    found = keyed.where(F.col("key") != _LOWEST).select(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * MOST_RANGES)).head()[0]
    bounds = np.array(sorted(set(found or [])), np.int64)

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(bounds, keys, batch.column(1)), pa.int64()), batch.column(0)], ["bucket", "key"])

    heads = {r.bucket: r.head for r in keyed.select("key", "spread").mapInArrow(bucket_of, "bucket long, key long").groupBy("bucket").agg(F.max("key").alias("head")).collect()}  # n rows at most
    order = sorted(heads)
    guests = {b: order[i + 1] if i + 1 < len(order) else order[0] for i, b in enumerate(order)}
    dealt = keyed.mapInArrow(_bucketed(bounds, guests, heads), "bucket long, guest boolean, key long, z binary").repartition("bucket")
    rows = dealt.sortWithinPartitions("bucket", "guest", F.desc("key"), "z").mapInArrow(_comparing(fingerprint), "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, check binary")
    classes = exact_classes(docs, key, text, fingerprint).withColumnRenamed("fingerprint", "f").withColumnRenamed("check", "c")
    joined = rows.join(classes, (F.col("fingerprint") == F.col("f")) & (F.col("check") == F.col("c")), "left")
    return joined.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("class_id", "key").alias("class_id"))
