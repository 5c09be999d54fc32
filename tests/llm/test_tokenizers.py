from __future__ import annotations

import hashlib
import random
import time
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a", "a  b", "\n\n x", "x\x1cy \x1f z", "a" * 35, "%" * 1001, "ab" * 500, "don't I'll  he's", " a　b ", "\U0001f600\U0001f600 é é", "日本語テキスト",
    "a\r\n\r\n  b\t\tc  ", "'" * 77, "_ _" * 50, " " * 300 + "x", "1234567890" * 40, "=-" * 300 + "<|endoftext|>", "İstanbul ΑΣ Σ", "a<|endoftext|>b c<|startoftext|>", "ﬁ ①", "x" * 20_000, "the the the " * 500,
]


def texts() -> list[str | None]:
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab 1'\n\x1d\x85 éß%日 s") for _ in range(rng.randint(1, 60))) for _ in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other", 7) for i, t in enumerate(texts())] + [(3, "again", "x", 1), (None, "no key", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int").repartition(3)


def test_encoding_equals_the_library(docs):
    library = library_of_ranks()
    got = bpe.encode(docs, RANKS)
    back = {(r.doc_id, len(r.decoded)): bytes(r.decoded) for r in bpe.decode(got, RANKS).collect()}
    rows = got.collect()
    assert len(rows) == docs.count()
    given = {(r.doc_id, r.text) for r in docs.collect()}
    for doc_id, text in given:
        ids = library.encode_ordinary(text or "")
        mine = [r for r in rows if r.doc_id == doc_id and list(r.ids) == ids]
        assert mine, (doc_id, text)
        assert mine[0].n_tokens == len(ids)
        assert mine[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine[0].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[doc_id, len((text or "").encode())] == (text or "").encode()


def library_of_ranks() -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS))


def ids_of(encoder: bpe.Encoder, text: str) -> list[int]:
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("window", [4, 8, 64, 1 << 20])
def test_windows_of_any_size_agree(encoder, monkeypatch, window):
    rng, library = random.Random(window), library_of_ranks()
    words = ["%" * n for n in range(2, 30)] + ["abab" * 9, "xyzzy" * 11, "aaaabaaaab" * 5, "=-+" * 200, "-" * 301]
    words += ["".join(rng.choice(["aa", "a", "ab", "-", "=", "--", "0", "12", "é", "日"][: rng.randint(1, 10)]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    monkeypatch.setattr(bpe, "WINDOW", window)
    encoder.ids.clear()
    assert [ids_of(encoder, w) for w in words] == [library.encode_ordinary(w) for w in words]


def test_long_unbroken_words_take_time_in_proportion(encoder):
    rng = random.Random(3)
    words = ["a" * 200_000, "0123456789" * 20_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "=-+" * 30_000, "".join("-" * rng.randint(1, 300) + "=" for _ in range(800))]
    for word in words:
        began = time.perf_counter()
        got = ids_of(encoder, word)
        assert time.perf_counter() - began < 5
        assert got == library_of_ranks().encode_ordinary(word)


def test_decoding_reads_the_ids(encoder):
    """Wrong, swapped and missing ids show in the bytes; parts of a long list come in order."""
    text = "one two \x00 three \U0001f600" * 50_000
    ids = np.array(library_of_ranks().encode_ordinary(text))
    assert len(ids) > bpe.DECODED // 2
    doubled = np.concatenate([ids, ids])
    swapped = np.concatenate([ids[1:2], ids[:1], ids[2:]])
    got = [b"".join(parts) for parts in encoder.decode([doubled, ids[:0], swapped, ids[:-1]])]
    assert got[0] == (text * 2).encode() and got[1] == b""
    assert got[2] == b" twoone" + text.encode()[7:] and got[3] != text.encode()


def test_lists_of_words_and_decoding_queries_are_bounded(monkeypatch):
    """What a worker holds beside its batch: the words of at most SLICE bytes of text, and a query's ids."""
    held, asked = [], []
    encode, bounded = bpe.Encoder.encode, bpe._bounded
    monkeypatch.setattr(bpe.Encoder, "encode", lambda self, texts: held.append(sum(map(len, texts))) or encode(self, texts))
    monkeypatch.setattr(bpe, "_bounded", lambda rows, items, most=bpe.CONTRACTED: (asked.append(sum(len(items[i]) for i in part)) or part for part in bounded(rows, items, most)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["one two three " * 5_000] * 40)], ["key", "text"])
    rows = [b for b in bpe._encode(types.SimpleNamespace(value=bpe.read_ranks(RANKS)), False)(iter([batch]))]
    assert sum(b.num_rows for b in rows) == 40 and len({x for b in rows for x in b.column("decoded_sha256").to_pylist()}) == 1
    assert max(held) <= 750_000 and max(asked) <= 300_000


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [0, 60_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, RANKS).collect()} == {1: None, 2: bytearray(), 3: bytearray()}


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(WORDS)
    rows = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, WORDS).collect()}
    for r in docs.collect():
        text = r.text or ""
        assert (r.doc_id, len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)) in rows, r


def test_pre_tokens_are_counted_once_and_joined(docs, monkeypatch):
    counted = token_counts.piece_counts(docs, WORDS).collect()
    distinct = {token_counts.key_of(w) for r in docs.collect() for w in token_counts.pre_tokens(r.text or "")}
    assert {r.word for r in counted} == distinct and len(counted) == len(distinct)
    assert {r.docs for r in counted if r.word == "the"} == {sum("the" in token_counts.pre_tokens(r.text or "") for r in docs.collect())}
    want = sorted(map(repr, token_counts.token_counts(docs, WORDS).collect()))
    for name, value in (("COMMON", 3), ("HELD", 1)):  # nearly all goes by the shuffle, in small parts
        monkeypatch.setattr(token_counts, name, value)
    assert sorted(map(repr, token_counts.token_counts(docs, WORDS).collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, RANKS).count() == 0 == token_counts.token_counts(none, WORDS).count()
    assert bpe.decode(none.select("doc_id", F.array(F.lit(1)).alias("ids")), RANKS).count() == 0


def test_long_runs_shared_by_many_texts_are_common_keys(spark):
    """A run longer than a key is counted whole and joined by its digest, by broadcast and by the shuffle alike; no row holds it."""
    long = ["http://x/" + "ab0" * 400, "é" * 257, "z" * 256, "q" * 100_000]
    texts = [f"{long[i % 4]} w{i} {long[(i + 1) % 4]} {long[0]}" for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(WORDS)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    words = {r.word for r in token_counts.piece_counts(docs, WORDS).collect()}
    assert max(map(len, words)) == 256 and sum(w.startswith(" ") for w in words) == 3
    for common in (100_000, 0):
        old, token_counts.COMMON = token_counts.COMMON, common
        try:
            assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, WORDS).collect()} == want
        finally:
            token_counts.COMMON = old
