"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, ship_package, slices

#: White_Space of Unicode. str.split() also cuts at 1C to 1F, which tokenizers keep inside words.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile("[\x1c-\x1f]")
_RUN = re.compile(f"[{WHITE}]+")
#: Characters of distinct pre-tokens that a task holds before it passes them on; results don't depend on it.
HELD = 8_000_000
#: The commonest pre-tokens whose counts are broadcast, and the characters of a pre-token that is its own key: their product
#: bounds the broadcast. All others are joined by a shuffle.
COMMON, KEY_CHARS = 100_000, 256
_loaded: dict[int, object] = {}


def pre_tokens(text: str) -> list[str]:
    """The runs between white space. No piece of a tokenizer that drops white space crosses one."""
    return [x for x in _RUN.split(text) if x] if _ODD.search(text) else text.split()


def key_of(word: str) -> str:
    """What a pre-token is joined by: itself or, if it is long, a blank, which no pre-token holds, and its SHA-256. So a long
    run that many documents share is a common key like any other, and no row carries it."""
    return word if len(word) <= KEY_CHARS else " " + hashlib.sha256(word.encode()).hexdigest()


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(spec)
    if key not in _loaded:
        t = Tokenizer.from_str(spec)
        t.no_truncation()
        t.no_padding()
        _loaded.clear()
        _loaded[key] = t
    return _loaded[key]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column("text"):
        yield value.as_py() or ""


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens of a partition and in how many of its documents they are, combined before the shuffle."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "docs"])

    found: Counter[str] = Counter()
    held = 0
    for batch in slices(batches, "text"):
        for text in _texts(batch):
            before, words = len(found), set(pre_tokens(text))
            found.update(words)
            held += len(text) if len(found) - before == len(words) else 8 * (len(found) - before)
        if held > HELD:
            yield out()
            found.clear()
            held = 0
    if found:
        yield out()


def _pieces(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in slices(batches, "word"):
            words = batch.column("word").to_pylist()
            sizes = [len(x) for at in range(0, len(words), 4096) for x in tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, words), pa.string()), batch.column("docs"), pa.array(sizes, pa.int64())], ["word", "docs", "pieces"])

    return released(run)


def _frequencies(common):
    """Per row the sum over common pre-tokens, and the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in slices(batches, "text"):
            sizes, sums, words, counts, ends = [], [], [], [], [0]
            for text in _texts(batch):
                sizes.append(len(text.encode()))
                total = 0
                for word, n in Counter(pre_tokens(text)).items():
                    word = key_of(word)
                    if (pieces := known.get(word)) is None:
                        words.append(word), counts.append(n)
                    else:
                        total += n * pieces
                sums.append(total), ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
            columns = [batch.column("row"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n_bytes", "common", "rest"])

    return released(run)


def piece_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """word (its key), docs, pieces of each distinct pre-token: counted once, however many documents hold it."""
    spark = docs.sparkSession
    ship_package(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer).read_text())  # as large as the vocabulary file
    found = docs.select(F.col(text).alias("text")).mapInArrow(released(_distinct), "word string, docs long")
    return found.groupBy("word").agg(F.sum("docs").alias("docs")).mapInArrow(_pieces(spec), "word string, docs long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of each row, as the `tokenizers` library gives them for the file `tokenizer`.

    The tokenizer must drop white space, as word tokenizers do: then a text's tokens are those of its runs between
    white space. A null text counts as empty (0 bytes, 0 tokens); a null key stays null; repeated rows are counted one
    by one; other columns are ignored; a very long text is split by one task, which holds it and its distinct runs.

    The pieces of each distinct pre-token are counted once and written. The table joins the frequencies of each row:
    by broadcast for the COMMON commonest, which are most of all frequencies and would be hot keys, by a shuffle for the
    rest, which is summed per row. Texts are read twice; ids are never made.
    """
    spark = docs.sparkSession
    counted = materialise(piece_counts(docs, tokenizer, text), "pieces")
    total = counted.count()
    rare = 0 if total <= COMMON else counted.select(F.percentile_approx("docs", 1 - COMMON / total, 10_000)).head()[0]
    top = counted.where(F.col("docs") > rare).orderBy(F.desc("docs"), "word").limit(COMMON)  # tasks send no others
    common = spark.sparkContext.broadcast({r.word: r.pieces for r in top.collect()})
    kind = dict(docs.dtypes)[key]
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialise(given.mapInArrow(_frequencies(common), f"row long, key {kind}, n_bytes long, common long, rest array<struct<word string, n long>>"), "frequencies")
    rest = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n").join(counted.select("word", "pieces"), "word")
    sums = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("others"))
    out = rows.drop("rest").join(sums, "row", "left")
    return out.select(F.col("key").alias(key), "n_bytes", (F.col("common") + F.coalesce("others", F.lit(0))).alias("n_tokens"))
