from __future__ import annotations

import hashlib
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lattica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pieces int"
TEXT = st.one_of(st.none(), st.text(st.sampled_from("ab\\<|>\n im_endstarté\U0001f600"), max_size=12), st.sampled_from(["<|im_end|>\n", "<|im_start|>assistant ok", "<|im_sep|>", "\\<|", "<\\|", "|im_end|>", "<"]))
TURNS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "a\nb", "assistant\nx", "\\n\n\\", "<|im_end|>"])), TEXT), min_size=1, max_size=25)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TURNS)
def test_read_back(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(frame).collect()}
    assert got == brute(rows)
    for r in chat.format_chats(frame).collect():
        at, loss = 0, ""
        for skip, take in r.loss_runs:
            at += skip
            loss += r.formatted[at : at + take]
            at += take
        mine = sorted((t, o or "", x or "") for c, t, o, x in rows if c == r.conv_id)
        assert loss == "".join(x.replace("\\", "\\\\").replace("<|", "<\\|") for _, o, x in mine if o == "assistant")


def test_template(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "a", 1), (1, 2, "assistant", "b", 1)]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).head()
    assert got.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n"


def test_null_conversation_and_empty_table(spark):
    frame = spark.createDataFrame([(None, 0, "user", "x", 1), (None, None, "user", "y", 1)], SCHEMA)
    assert [(r.conv_id, r.n_turns) for r in chat.digests(frame).collect()] == [(None, 2)]
    assert chat.digests(frame.where("turn > 5")).count() == 0


def test_the_loss_comes_through_the_mask(spark, monkeypatch):
    """Another mask gives another loss; runs beyond one piece and one block of sums are cut whole."""
    monkeypatch.setattr(chat, "PIECE", 7)
    monkeypatch.setattr(chat, "RUNS", 3)
    rows = [(1, i, ["user", "assistant", "assistant\nx"][i % 3], "\\<|\U0001f600 text %d " % i + "z" * (i % 40), 1) for i in range(50)]
    one = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    loss = one.select(chat.loss_text(F.col("formatted"), F.col("loss_runs")).alias("x")).head().x
    assert loss == "".join(x for _, _, r, x, _ in rows if r == "assistant")
    swapped = F.transform("loss_runs", lambda r: F.struct((r["skip"] + 1).alias("skip"), F.greatest(r["take"] - 1, F.lit(0)).cast("long").alias("take")))
    assert one.select(chat.loss_text(F.col("formatted"), swapped).alias("x")).head().x != loss
    none = F.transform("loss_runs", lambda r: F.struct((r["skip"] + r["take"]).alias("skip"), F.lit(0).cast("long").alias("take")))
    assert one.select(chat.loss_text(F.col("formatted"), none).alias("x")).head().x == ""
    assert one.select(chat.loss_text(F.lit("abc"), F.filter("loss_runs", lambda r: F.lit(False))).alias("x")).head().x == ""
    assert one.select(chat.loss_text(F.lit(None).cast("string"), F.col("loss_runs")).alias("x")).head().x is None


def test_many_turns_in_one_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words é ").alias("text"))
    began = time.perf_counter()
    got = chat.digests(turns).head()
    assert time.perf_counter() - began < 60
    assert (got.n_turns, got.loss_chars) == (20_000, 10_000 * 13)
    assert got.loss_sha256 == hashlib.sha256(("some words é " * 10_000).encode()).hexdigest()
