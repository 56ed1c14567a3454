"""Prefix-target expansion: each assistant turn becomes an example with all turns before it as context.

A turn is written as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end.  Control strings in
texts are escaped by a backslash after ``<`` (``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|`` and so on), so no text can
open or close a turn and every text comes back exactly.  Roles are percent-encoded where a mark or line end would
break the header line.  An example carries its loss mask as one span of code points: the reply's text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _role(turn["role"]), F.lit("\n"))


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), escape(t["text"]), F.lit(END + "\n"))), "")


def expand(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` int (from 1), ``n_turns`` int, ``formatted`` string,
    ``loss_start`` and ``loss_length`` int (code points; the reply's escaped text).

    Turns are ordered by number, ties by role and text; repeated rows stay repeated turns; a null number comes last.
    Null roles and texts count as empty.  Rows with a null ``conv_id`` form one conversation.  Turns after the last
    reply are kept in a closing example that has no trainable text (length 0).  Other columns are ignored; an empty
    table gives no examples.  An example holds its whole context by definition, so one conversation is one group.
    """
    one = F.struct(
        F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    replies = F.filter(numbers, lambda i: (F.element_at("turns", i)["role"] == target) | (i == F.size("turns")))
    cut = whole.select("conv_id", "turns", F.posexplode(replies).alias("at", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    parts = cut.select(
        "conv_id", (F.col("at") + 1).alias("example"), "n_turns",
        _written(F.slice("turns", F.lit(1), F.col("n_turns") - 1)).alias("context"),
        _head(last).alias("head"), escape(last["text"]).alias("reply"), (last["role"] == target).alias("trains"),
    )
    return parts.select(
        "conv_id", "example", "n_turns",
        F.concat("context", "head", "reply", F.lit(END + "\n")).alias("formatted"),
        (F.length("context") + F.length("head")).alias("loss_start"),
        F.when(F.col("trains"), F.length("reply")).otherwise(F.lit(0)).alias("loss_length"),
    )


def turns_of(formatted: Column) -> Column:
    """Read an example back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def read(piece: Column) -> Column:
        cut = F.instr(piece, F.lit("\n"))
        body = F.substr(piece, cut + 1, F.length(piece) - cut - len(END) - 1)
        return F.struct(_plain_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substr(formatted, start + 1, length))
