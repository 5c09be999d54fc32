"""WARC archives: written by Spark's text writer, read by a Python data source that skips payloads nobody wants."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import materialise, open_store, ship_package

_BREAK = "\r\n"
#: Revisits (some 60 bytes each) up to which their table is broadcast.
MOST_BROADCAST = 100_000
#: Alphabet of RFC 4648 base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record headers that become columns.
HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "record_id": "warc-record-id", "page_id": "x-page-id", "full_length": "x-payload-length"}


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of a text's SHA-1: 160 bits are 32 digits, four for each five hexadecimal ones."""
    digits = F.lit(_BASE32)
    hexes = F.sha1(F.encode(text, "UTF-8"))
    value = lambda i: F.conv(F.substring(hexes, i * 5 + 1, 5), 16, 10).cast("int")
    digit = lambda v, k: F.substring(digits, F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[digit(value(i), k) for i in range(8) for k in range(4)])


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, rows_per_file: int = 20_000) -> None:
    """Writes a record per row under `path`, on any file system that Spark knows.

    Of rows with equal payloads of at least `least` bytes, that with the smallest key is a response and the others are
    revisits that name it and carry no payload. Null payloads are empty; repeated rows are responses, each
    of them, and rows without a key are always responses. Line breaks in a URL become blanks, a null URL is
    urn:page:<key>. A very long payload is one row of the text writer. A record ends with two line breaks, the writer's line separator.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    digested = rows.withColumn("n", F.octet_length("h").cast("long")).withColumn("d", base32_sha1(F.col("h")))
    light = digested.where(F.col("n") >= least).select("k", "d")
    first = light.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = materialise(light.join(first, "d").where("k != first").select(F.col("k").alias("ak"), F.col("d").alias("ad"), "first").distinct(), "revisits")
    # payloads are shuffled only where there are many revisits, which then carry none
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    joined = digested.join(again, (F.col("k") == F.col("ak")) & (F.col("d") == F.col("ad")), "left")
    revisit = F.col("first").isNotNull() & (F.col("n") >= least)
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("h")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))
    uri = F.regexp_replace(F.coalesce(F.col("u"), F.concat(F.lit("urn:page:"), F.col("k").cast("string")), F.lit("urn:page:none")), r"[\r\n]", " ")
    record = F.concat(
        F.lit("WARC/1.1" + _BREAK),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("k").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(_REVISIT)))).otherwise(F.lit("")),
        F.when(F.col("k").isNotNull(), line("X-Page-ID", F.col("k").cast("string"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_BREAK),
        block,
    )
    joined.select(record.alias("value")).write.option("lineSep", _BREAK * 2).option("maxRecordsPerFile", rows_per_file).text(path)


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    """One partition per file; a record is parsed from its headers, and its block is passed over unless wanted."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.wanted: dict[str, set[str]] = {}
        if "recordtypes" in {k.lower() for k in options}:
            self.wanted["record_type"] = set({k.lower(): v for k, v in options.items()}["recordtypes"].split(","))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "target_uri", "record_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        files = sorted(x.path for x in found if x.is_file and x.size and not x.base_name.startswith(("_", ".")))
        return [_File(f"{scheme}://{x}") for x in files] or [_File("")]  # Spark wants a partition

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.uri:
            return
        store, path = open_store(partition.uri)
        with store.open_input_file(path) as raw:
            yield from records(raw, self.wanted, self.payload)


def _lines(raw) -> Iterator[bytes]:
    while True:
        line = raw.readline()
        if line in (b"\r\n", b"\n", b""):
            return
        yield line


def records(raw, wanted: dict[str, set[str]], payload: bool) -> Iterator[tuple]:
    """Rows of an open archive; `wanted` holds the values allowed per column. Header lines alone decide on a record."""
    import io

    raw = io.BufferedReader(raw, 1 << 20) if not hasattr(raw, "peek") else raw
    while first := raw.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {}
        for line in _lines(raw):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        row = {column: head.get(name) for column, name in HEADERS.items()}
        if any(row.get(column) not in values for column, values in wanted.items()):
            raw.seek(size, 1)
            continue
        body, length, digest = None, None, None
        if row["record_type"] == "response" and payload:
            block = raw.read(size)
            if len(block) < size:
                raise ValueError("a WARC record ends early")
            at = block.find(b"\r\n\r\n")
            body = block[at + 4 :] if block.startswith(b"HTTP/") and at >= 0 else block
            length, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            raw.seek(size, 1)
        yield (row["record_type"], row["target_uri"], (row["payload_digest"] or "").removeprefix("sha1:") or None, row["refers_to"], row["record_id"], int(row["page_id"]) if row["page_id"] else None, int(row["full_length"]) if row["full_length"] else None, body, length, digest)


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "record_type string, target_uri string, payload_digest string, refers_to string, record_id string, page_id long, full_length long, payload binary, read_length long, read_digest string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_warc(spark: SparkSession, path: str, record_types: tuple[str, ...] | None = None, payload: bool = True) -> DataFrame:
    """Records under `path`. Equality and IN filters on record_type, target_uri and record_id are pushed down (Spark
    asks for spark.sql.python.filterPushdown.enabled, set here), and so is record_types. Without `payload`, blocks are
    passed over and payload, read_length and read_digest are null. An empty folder has no records."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    if record_types:
        reader = reader.option("recordTypes", ",".join(record_types))
    return reader.load(path)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages to archives under `path` and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of a response, length and digest are those of the payload read; of a revisit, those its headers give.
    """
    write_warc(pages, path)
    got = read_warc(pages.sparkSession, path)
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return got.select(
        "page_id", F.coalesce("read_length", "full_length").alias("payload_bytes"), F.coalesce("read_digest", "payload_digest").alias("payload_digest"), "record_type",
        F.when(F.col("refers_to").isNotNull(), refers).alias("refers_to"),
    )
