"""The whole pipeline on a small table against versions that share no code with its operators."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import tiktoken
from test_mixing import targets
from test_neardup import brute, corpus, words

import corpus_pipeline
from lattica.llm import bpe, queries


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    source = {k: "abc"[k % 3] for k, _ in rows}
    docs = spark.createDataFrame([(k, t, "en", source[k], len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    # without labels nothing is toxic, so the first stage keeps every row
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text, groups = dict(rows), brute(rows)
    kept = {k for k, (_, first) in groups.items() if first == k}
    assert 0 < len(kept) < len(rows)
    whole = Counter()
    for k in kept:
        whole[source[k]] += len(words(text[k]))
    target, taken = targets(dict(whole)), Counter()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BYTE_BPE), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in got)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    assert set(copies) <= kept
    for k in kept:
        taken[source[k]] += copies[k] * len(words(text[k]))
        share = target[source[k]] / whole[source[k]]
        assert int(share) <= copies[k] <= int(share) + 1
    for s in whole:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]), (s, taken[s], target[s])
