"""Chat formatting with Spark expressions only: sorted turn structs, merged neighbours of one role, concatenation.

Template: a block per run of turns of one role, "<|im_start|>role\\n" text "<|im_sep|>" text ... "<|im_end|>\\n". Inside
roles and texts a backslash becomes two and "<|" becomes "<\\|", so no control string can arise there; in roles a line
break becomes a backslash and "n", so that the first line break of a block ends the role.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Code points of a piece in which the loss mask looks up its runs, and runs that are summed as one.
PIECE, RUNS = 4096, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes escape and escape_role: between doubled backslashes, a single one starts an escape."""
    plain = lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _quote(marker: str) -> str:
    return "".join("\\" + c if c in "|[](){}.*+?^$\\" else c for c in marker)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv, formatted, loss_runs: one row per conversation.

    loss_runs has a struct (skip, take) per turn, in code points of `formatted`: so many without loss, then so many
    under it; `take` is 0 unless the role is `learn`. Rows go by turn, then role, then text, nulls first; a null role
    or text is empty; repeated rows are turns of their own; rows with a null conversation id form one conversation.
    An empty table gives no rows; other columns are ignored. One shuffle by conversation; a conversation is one
    training example, so it must fit in a row, however long its texts.
    """
    structs = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("one"),
    )
    ordered = structs.groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    n = F.size("turns")

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        opened, closed = (i == 0) | (before != x["role"]), (i == n - 1) | (after != x["role"])
        head = F.when(opened, F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(SEPARATOR))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(closed, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"), (x["role"] == learn).alias("learnt"))

    merged = ordered.select("conv", F.transform("turns", piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")

    def run(p: Column, i: Column) -> Column:
        left = F.when(i == 0, F.lit(0)).otherwise(F.char_length(F.get(F.col("pieces"), i - 1)["tail"]))
        return F.struct((left + F.char_length(p["head"]) + F.when(p["learnt"], 0).otherwise(F.char_length(p["body"]))).cast("long").alias("skip"), F.when(p["learnt"], F.char_length(p["body"])).otherwise(0).cast("long").alias("take"))

    return merged.select(F.col("conv").alias(conv), formatted.alias("formatted"), F.transform("pieces", run).alias("loss_runs"))


def read_chats(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Adds `turns`, an array of (role, text) read back from the formatted string; a null string gives a null array."""
    blocks = F.filter(F.split(F.col(column), _quote(END) + "\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.locate("\n", block)
        role = unescape(F.substring(block, F.lit(len(START) + 1), at - 1 - len(START)))
        texts = F.split(F.substring(block, at + 1, F.char_length(block)), _quote(SEPARATOR))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, not for each element of a lambda that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column) -> Column:
    """Sums of an array of longs up to each element: of blocks first, then inside blocks, so that no long array is
    copied for each element."""

    def up_to(values: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["sums"], F.array(s["sum"] + x)).alias("sums")), lambda s: s["sums"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
        bases = _let(totals, lambda t: F.zip_with(up_to(t, F.lit(0).cast("bigint")), t, lambda s, x: s - x))
        return F.flatten(F.zip_with(blocks, bases, up_to))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / RUNS), F.lit(0)).cast("int")), lambda b: F.slice(xs, b * RUNS + 1, F.lit(RUNS)))
    return _let(_let(numbers, cut), of_blocks)


def loss_text(formatted: Column, loss_runs: Column) -> Column:
    """What lies under the mask in a formatted string, unescaped: cut out run by run, each from the few pieces of PIECE code
    points that it touches, so that time grows with the string, not with runs times string. Null for a null."""

    def cut(pieces: Column, run: Column, end: Column) -> Column:
        start = end - run["take"]
        first, last = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
        touched = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.when(run["take"] > 0, unescape(F.substring(touched, (start % PIECE + 1).cast("int"), run["take"].cast("int")))).otherwise(F.lit(""))

    ends = _running(F.transform(loss_runs, lambda r: r["skip"] + r["take"]))
    pieces = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    cuts = _let(pieces, lambda p: F.zip_with(loss_runs, ends, lambda run, end: cut(p, run, end)))
    return F.when(formatted.isNotNull(), F.array_join(cuts, ""))


def digests(turns: DataFrame, **names) -> DataFrame:
    """Formats conversations and reads them back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss is what the mask cuts out of the formatted string.
    """
    conv = names.get("conv", "conv_id")
    back = read_chats(format_chats(turns, **names)).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_runs")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
