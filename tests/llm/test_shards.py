from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe, shards

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 62))
def test_slots_are_a_permutation(n, key):
    got = shards.slots(np.arange(n), n, key)
    assert sorted(got.tolist()) == list(range(n))
    assert (shards.slots(np.arange(n)[::-1], n, key)[::-1] == got).all()


def test_keys_differ_and_mix():
    a, b = shards.slots(np.arange(1000), 1000, 1), shards.slots(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, ["some text %d " % i * (i % 40), None, "", "x"][i % 4 if i % 9 == 0 else 0], 1) for i in range(120)], "doc_id long, text string, slot int")


def test_round_trip(docs, tmp_path):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    made = shards.write_shards(docs, f"file://{tmp_path}/s", RANKS, length=64, per_shard=8)
    rows = made.orderBy("shard").collect()
    n = sum(r.sequences for r in rows)
    assert [r.first_slot for r in rows] == [8 * i for i in range(len(rows))] and all(r.sequences == 8 for r in rows[:-1])
    assert all((tmp_path / "s" / f"shard-{r.shard:08d}.bin").stat().st_size == r.sequences * 128 for r in rows)
    got = shards.read_sequences(made, length=64, with_ids=True).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(n))
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u2").tobytes()).hexdigest() for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = sum(len(library.encode_ordinary(t or "")) + 1 for t in texts.values())
    assert sum(r.n_tokens for r in got) == whole == sum(r.n_tokens for r in rows)
    spoken = sorted(x for r in got for x in r.ids if x != shards.FILL)
    assert spoken == sorted(x for t in texts.values() for x in [*library.encode_ordinary(t or ""), 50256])
    rest = shards.read_sequences(made, start=11, length=64).orderBy("slot").collect()
    assert [(r.slot, r.ids_sha256) for r in rest] == [(r.slot, r.ids_sha256) for r in got[11:]]


def test_each_slot_holds_its_sequence(spark, tmp_path):
    """Against a loop: partition by partition, documents are strung together with end marks and cut; slot P(i) holds cut i."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = [(i, f"some words of text {i} " * (i * 7 % 23) if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    want = []
    for part in docs.rdd.glom().collect():
        stream = [x for r in part for x in [*library.encode_ordinary(r.text or ""), 50256]]
        stream += [shards.FILL] * (-len(stream) % 32)
        want += [stream[at : at + 32] for at in range(0, len(stream), 32)]
    made = shards.write_shards(docs, f"file://{tmp_path}/s", RANKS, key=5, length=32, per_shard=8)
    got = {r.slot: list(r.ids) for r in shards.read_sequences(made, length=32, with_ids=True).collect()}
    place = shards.slots(np.arange(len(want)), len(want), 5)
    assert len(want) > 20 and got == {int(place[i]): ids for i, ids in enumerate(want)}
    assert sorted(place.tolist()) != place.tolist()


def test_same_key_same_shards(docs, tmp_path):
    one = shards.write_shards(docs, f"file://{tmp_path}/a", RANKS, length=64, per_shard=8)
    two = shards.write_shards(docs, f"file://{tmp_path}/b", RANKS, length=64, per_shard=8)
    assert sorted(r.sha256 for r in one.collect()) == sorted(r.sha256 for r in two.collect())


def test_empty(docs, tmp_path):
    assert shards.shard_round_trip(docs.where("doc_id < 0"), f"file://{tmp_path}/s", RANKS).count() == 0
