"""Preference formatting: a pair of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (role and text equal), rendered once. Each completion
is the rest of its conversation; its mask lists the character spans that the assistant wrote, which
are the ones to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """[start, length] in characters, in the rendered turns, of what the assistant wrote with its close mark."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + F.lit(len(OPEN) + len(MIDDLE))
        body = (F.length(t["text"]) + F.lit(len(CLOSE))).cast("long")
        here = F.array(F.struct((acc["at"] + head).cast("long").alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """One row per row of ``pairs(pair_id, chosen, rejected)``; both are arrays of struct(role, text), in order.

    Null arrays are empty conversations; null roles and texts are empty strings. Two equal conversations
    give two empty completions. Repeated pairs give repeated rows; other columns are dropped.
    """
    clean = lambda c: F.transform(
        F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    both = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.transform(F.slice("c", F.lit(1), shorter), lambda t, i: ~(t == F.get("r", i)))
    first = F.array_position(differs, True)
    cut = both.withColumn("n", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    whole = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    split = cut.select("pair_id", F.col("n").alias("prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return split.select(
        "pair_id",
        "prompt_turns",
        whole(F.col("p")).alias("prompt"),
        whole(F.col("c")).alias("chosen"),
        whole(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_mask"),
        _spans(F.col("r")).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from ``conversations(conv_id, turn, role, text)``, one for each conversation, which is chosen; pair_id is its conv_id.

    Its neighbour is 2k + 1 for 2k and 2k for 2k + 1. Rejected is the conversation with its last assistant turn, and
    what follows, replaced by the last assistant turn of the neighbour and what follows that. So each turn of the
    table is rendered in the pair of its own conversation.

    Turns stand in the order of turn, role and text (nulls first). Rows without conv_id belong to no
    conversation. Without a neighbour, or without an assistant turn there, the rejected conversation ends before
    the replaced turn; one without an assistant turn is followed by the neighbour's. One record holds two
    neighbours, as it must to render them; no key joins more.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("k"),
        (F.col("conv_id").cast("long").bitwiseAND(F.lit(1)) == 0).alias("even"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sides = rows.groupBy("k").agg(
        F.array_sort(F.collect_list(F.when(F.col("even"), F.col("t")))).alias("x"),
        F.array_sort(F.collect_list(F.when(~F.col("even"), F.col("t")))).alias("y"),
    )
    way = lambda pair_id, a, b: F.struct(pair_id.alias("pair_id"), F.col(a).alias("a"), F.col(b).alias("b"))
    sides = sides.select(F.inline(F.array(way(F.col("k") * 2, "x", "y"), way(F.col("k") * 2 + 1, "y", "x")))).where(F.size("a") > 0)
    bare = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    last = lambda c: F.coalesce(F.array_max(F.filter(F.transform(c, lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())), F.lit(0))
    keep = F.when(last("a") > 0, last("a") - 1).otherwise(F.size("a"))
    tail = F.when(last("b") > 0, F.slice("b", last("b"), F.size("b") - last("b") + 1)).otherwise(F.slice("b", 1, 0))
    return sides.select("pair_id", bare(F.col("a")).alias("chosen"), bare(F.concat(F.slice("a", F.lit(1), keep), tail)).alias("rejected"))


def preference_documents(conversations: DataFrame) -> DataFrame:
    """Formatted pairs with masks as text ("start:length" joined by commas), one row per pair."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit(":"), s["length"])), ",").alias(c)
    return format_pairs(neighbour_pairs(conversations)).select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", shown("chosen_mask"), shown("rejected_mask"))
