"""op12's repair against a search over all edits, and against a plain Viterbi pass over whole strings."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lattica.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, gone string, copy int, conv string"
ROLE = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]))
TEXT = st.one_of(st.none(), st.sampled_from(["a.", "b.", "c!", "d", "", " \n", "e?\t", "f. "]))


def facts(rows):
    """(gaps, blank, duplicate, truncated, illegal) and each row's (role, text, fault) of a conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    seen, marked, illegal = set(), [], 0
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    count = lambda k: sum(m[2] == k for m in marked)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal), marked


def search(marked):
    """The least (cost, audit, output) by trying all edits, with at most two inserts between rows."""
    best = None
    todo = [(0, "", (), 0, 0)]
    while todo:
        cost, audit, out, at, inserts = todo.pop()
        if best and cost > best[0]:
            continue
        if at == len(marked) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserts < 2:
            todo += [(cost + 5, audit + "I", (*out, (r, "")), at, inserts + 1) for r in ("user", "assistant")]
        if at < len(marked):
            role, text, fault = marked[at]
            todo.append((cost + 2, audit + "D", out, at + 1, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                todo.append((cost + more, audit + "K", (*out, (role, text)), at + 1, 0))
                todo += [(cost + 1 + more, audit + "R", (*out, (r, text)), at + 1, 0) for r in ("user", "assistant")]
    return best


def plain(marked):
    """(cost, audit) by a Viterbi pass that carries whole strings."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def close(layer):
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if a in layer:
                layer[b] = min(layer.get(b, (1 << 60, "")), (layer[a][0] + 5, layer[a][1] + "I"))
        return layer

    layer = close({0: (0, "")})
    for role, _, fault in marked:
        now = {}
        for s, (cost, audit) in layer.items():
            more = 5 if fault else 0
            offers = [(s, (cost + 2, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                offers += [(step[role[:1]][s], (cost + more, audit + "K"))] if s in step.get(role[:1], {}) else []
                offers.append((3 if s == 2 else 2, (cost + 1 + more, audit + "R")))
            for to, value in offers:
                now[to] = min(now.get(to, (1 << 60, "")), value)
        layer = close(now)
    return min(layer[s] for s in (0, 3) if s in layer)


def run_rows(spark, rows, **how):
    """Repairs rows (conv, turn, role, text) without damage."""
    frame = spark.createDataFrame([(*r, False, "x") for r in rows], "conv long, turn long, role string, text string, gone boolean, extra string")
    return {r.conv: r for r in sr.repair(frame, **how).collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 30)), st.one_of(st.none(), st.integers(0, 5)), ROLE, TEXT), max_size=60))
def test_damage_and_repair(spark, rows):
    frame = spark.createDataFrame([(*r, "g", 1, "c") for r in rows], SCHEMA)
    got = {r.conv: tuple(r)[1:] for r in sr.repair(sr.damaged(frame), keep_turns=False).collect()}
    after = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after[c] += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert set(got) == set(after)
    for c, mine in after.items():
        counts, marked = facts(mine)
        cost, audit = plain(marked)
        assert got[c][:7] == (*counts, cost, audit)
        if len(marked) <= 5:
            cost, audit, out = search(marked)
            assert got[c][5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b!", "c?", "d", "", "e.", "f.", "g.", "h"])), max_size=300), st.sampled_from([1, 2, 3, 5, 8, 256]))
def test_looks_change_nothing(rows, look):
    """However often audits are settled and ranked, cost, audit and output are those of whole strings."""
    old, sr.LOOK = sr.LOOK, look
    try:
        one = sr.Repair(True)
        for i, (role, text) in enumerate(rows):
            one.add(i, role, text)
        got = one.result()
    finally:
        sr.LOOK = old
    _, marked = facts([(i, r, x) for i, (r, x) in enumerate(rows)])
    assert got[5:7] == plain(marked)
    said = "\n".join(f"{t['role']}:{t['text']}" for t in got[8])
    assert got[7] == hashlib.sha256(said.encode()).hexdigest() and re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in got[8]))


def test_real_output(spark):
    rows = [(1, 0, "system", "be brief."), (1, 1, "user", "hi?"), (1, 2, "assistant", "hi."), (1, 3, "assistant", "hi."), (1, 6, "tool", "x."), (2, None, "assistant", "yes."), (3, 0, "", ""), (4, 0, "user", "q?")]
    got = run_rows(spark, rows)
    assert [(t.role, t.text) for t in got[1].repaired] == [("system", "be brief."), ("user", "hi?"), ("assistant", "hi.")] and got[1].audit == "KKKDD" and got[1].gaps == 2
    assert (got[2].audit, got[2].cost, got[2].repaired) == ("D", 2, [])
    assert (got[3].blank, got[3].audit) == (1, "D") and (got[4].cost, got[4].audit) == (2, "D")


def test_long_conversation_and_long_text(spark):
    turns = spark.range(60_000).selectExpr("1L AS conv", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id, '.') AS text", "false AS gone")
    began = time.perf_counter()
    got = sr.repair(turns, keep_turns=False).head()
    assert time.perf_counter() - began < 60 and len(got.audit) >= 60_000
    assert run_rows(spark, [(1, 0, "user", "w " * 1_000_000 + "?"), (1, 1, "assistant", "x" * 2_000_000 + ".")])[1].audit == "KK"
    assert run_rows(spark, []) == {}
