"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the grammar (s?(ua)+)?.

A forward Viterbi pass per conversation over four grammar states (nothing yet, after system, after user, after
assistant) carries the least (cost, audit string) of each state. Before the first turn and after each one the layer is
closed by inserts: a user turn from any other state, then an assistant turn after a user turn; more can't be cheaper.
An audit has a letter per edit, in order: Keep, Rerole, Delete, Insert. With the turns and the grammar it says all: the
next role of a place in the output is known, so Rerole and Insert need no name.

Audits of one layer and one cost are compared as strings. Neither can be the beginning of the other: both have a letter
per turn so far, so they could differ in Inserts alone, and these cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, ship_package

#: What edits cost; a turn that is kept or given another role though it is cut off costs CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. Role initial -> state before -> state after.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
#: Turns between two looks at what the audits share, and conversations in a batch of results.
LOOK, BATCH = 256, 512
DAMAGES = 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def crc32_of(key: Column) -> Column:
    return F.crc32(F.encode(key, "UTF-8"))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: turns with faults put in by crc32(conv:turn) % 20.

    0 drops a turn (one row stays, marked `gone`, so that the conversation is known), 1 empties its text, 2 removes its
    full stops, question and exclamation marks, 3 repeats it, 4 makes its role user. A null role or text, and in the hashed
    text a null id or turn, is one space. Rows that are equal, or share conversation and turn, get the same fault.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"), (crc32_of(key) % DAMAGES).alias("fault"))
    cut = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    faulty = rows.select("conv", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), cut.alias("text"), (F.col("fault") == 0).alias("gone"), "fault")
    slim = lambda c: F.when(~F.col("gone"), F.col(c)).alias(c)
    return faulty.select("conv", slim("turn"), slim("role"), slim("text"), "gone", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


class Repair:
    """One conversation, turn by turn. Holds of each state the least (cost, rank, letters): letters since audits were last
    shared or ranked, rank their order before that, `before` what was ranked. `ready` turns are those whose edits are settled."""

    def __init__(self, keep_turns: bool):
        self.layer: list[tuple[int, int, str] | None] = [(0, 0, ""), None, None, None]
        self.before: list = [None]  # rank -> chain (chain before, letters)
        self.waiting: list[tuple[str, str]] = []
        self.keep_turns, self.turns, self.audit = keep_turns, [], []
        self.hash, self.written, self.offset = hashlib.sha256(), 0, 0
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.last_role: str | None = None
        self.least_turn = self.last_turn = None
        self.distinct_turns = 0
        self._close()

    def _offer(self, layer: list, state: int, value: tuple[int, int, str]) -> None:
        if layer[state] is None or value < layer[state]:
            layer[state] = value

    def _close(self) -> None:
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if self.layer[a]:
                cost, rank, letters = self.layer[a]
                self._offer(self.layer, b, (cost + INSERT, rank, letters + "I"))

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.last_turn, self.distinct_turns = turn, self.distinct_turns + 1
        end = text.rstrip(BLANKS)[-1:]
        same = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        must_go = cut = False
        if not end:
            self.blank, must_go = self.blank + 1, True
        elif same in self.seen:
            self.duplicate, must_go = self.duplicate + 1, True
        elif end not in ".!?":
            self.truncated, cut = self.truncated + 1, True
        self.seen.add(same)
        if self.rows and self.last_role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.rows, self.last_role = self.rows + 1, role
        layer: list = [None] * 4
        more = CUT if cut else 0
        for state, best in enumerate(self.layer):
            if best is None:
                continue
            cost, rank, letters = best
            self._offer(layer, state, (cost + DELETE, rank, letters + "D"))
            if not must_go:
                if (to := NEXT.get(role[:1], {}).get(state)) is not None:
                    self._offer(layer, to, (cost + more, rank, letters + "K"))
                self._offer(layer, 3 if state == 2 else 2, (cost + REROLE + more, rank, letters + "R"))
        self.layer = layer
        self.waiting.append((role, text))
        if self.rows % LOOK == 0:
            self._look()
        self._close()

    def _look(self) -> None:
        """Drops states that can't win, settles what all audits share, and ranks the rest, so that letters stay short.

        After an assistant turn all can follow that can after a system turn, and after nothing but a system turn, which
        can be deleted instead. No audit here is the beginning of another, as all end in a turn's letter."""
        done = self.layer[3]
        if done and self.layer[1] and self.layer[1][0] > done[0]:
            self.layer[1] = None
        if done and self.layer[0] and self.layer[0][0] > done[0] + DELETE:
            self.layer[0] = None
        alive = [x for x in self.layer if x]
        if len({x[1] for x in alive}) == 1:
            self._settle(self.before[alive[0][1]])
            shared = commonprefix([x[2] for x in alive])
            self._replay(shared)
            self.before = [None]
            self.layer = [x and (x[0], 0, x[2][len(shared) :]) for x in self.layer]
            if max(len(x[2]) for x in alive) - len(shared) < LOOK:
                return
        order = sorted({x[1:] for x in self.layer if x})
        chains = [(self.before[rank], letters) for rank, letters in order]
        self.layer = [x and (x[0], order.index(x[1:]), "") for x in self.layer]
        self.before = chains

    def _settle(self, chain) -> None:
        parts = []
        while chain:
            chain, letters = chain
            parts.append(letters)
        for letters in reversed(parts):
            self._replay(letters)

    def _replay(self, letters: str) -> None:
        """Carries out settled edits."""
        at = 0
        for letter in letters:
            role, text = (None, "") if letter == "I" else self.waiting[at]
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K":
                if not self.written and role[:1] == "s":
                    self.offset = 1
            else:
                role = "assistant" if (self.written - self.offset) % 2 else "user"
            self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            if self.keep_turns:
                self.turns.append({"role": role, "text": text})
            self.written += 1
        del self.waiting[:at]
        self.audit.append(letters)

    def result(self) -> tuple:
        cost, rank, letters = min(x for x in (self.layer[0], self.layer[3]) if x)
        self._settle(self.before[rank])
        self._replay(letters)
        gaps = self.last_turn - self.least_turn + 1 - self.distinct_turns if self.distinct_turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest(), self.turns


def repair(turns: DataFrame, keep_turns: bool = True) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, with `keep_turns`, repaired, an
    array of (role, text): a row per conversation of turns(conv, turn, role, text, gone).

    Rows go by turn (null first), role, text; `gone` rows only make their conversation known. A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated. Null ids form one conversation; a null or empty role has no
    initial and is reroled or deleted; an empty table gives no rows. Ties between cheapest edits go to the ASCII-least audit.

    One shuffle by conversation, sorted in Spark, and one pass: a task holds a digest of each turn of the conversation at
    hand, and its turns only until their edits are settled, which later ones seldom undo. Very long texts pass through.
    """
    ship_package(turns.sparkSession)
    kind = dict(turns.dtypes)["conv"]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv {kind}, {counts}, audit string, repaired_sha256 string" + ", repaired array<struct<role: string, text: string>>" * keep_turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pa.struct([("role", pa.string()), ("text", pa.string())])
        kinds = [pa.int64()] * len(COUNTS) + [pa.string(), pa.string()] + [pa.list_(said)] * keep_turns
        names, out = ["conv", *COUNTS, "audit", "repaired_sha256", *["repaired"] * keep_turns], []
        at, now, key_kind = None, None, None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_kind), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=False))], names)

        for batch in batches:
            key_kind = batch.column("conv").type
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone")), strict=True):
                if now is None or conv != at:
                    if now:
                        out.append((at, *now.result()))
                        if len(out) == BATCH:
                            yield rows()
                            out.clear()
                    at, now = conv, Repair(keep_turns)
                if not gone:
                    now.add(turn, role or "", text or "")
        if now:
            out.append((at, *now.result()))
        if out:
            yield rows()

    together = turns.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return together.select("conv", "turn", "role", "text", "gone").mapInArrow(released(run), schema)
