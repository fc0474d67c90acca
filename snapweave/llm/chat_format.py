"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is the prompt, the rest two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a turn is written.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in order of turn, then role and text.

    Rows of a null conv_id or turn number belong to no conversation and are left out; a null role is
    "user", a null text empty; rows that repeat a turn whole count once. A conversation is one row, as large
    as its text.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def truncated_negatives(talks: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: rejected is chosen with its last assistant turn cut to the first half of its words, and what follows left out.

    Conversations without an assistant turn have no pair and are left out. A reply of one word or none is
    cut to nothing.
    """
    at = F.array_size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit("assistant"))
    found = talks.where(F.exists("turns", lambda t: t["role"] == "assistant")).withColumn("_at", at.cast("int"))
    last = F.get("turns", F.col("_at"))
    words = F.split(last["text"], " ", -1)
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.array_size(words) / 2).cast("int")), " ")
    cut = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), half.alias("text"))
    return found.select("conv_id", F.slice("turns", F.lit(1), F.col("_at") + 1).alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_at")), F.array(cut)).alias("rejected"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """For rows of conv_id, chosen and rejected (arrays of turn, role, text): the prompt once, and both completions with their masks.

    prompt_turns counts the longest prefix of turns that are equal in role and text. A completion's mask is a
    list of (start, end) in its characters, end exclusive: the text and end mark of each assistant turn, on
    which loss is taken; all else, and the prompt, has none. A side that ends within the prefix has an empty
    completion. Null arrays count as empty; other columns are not kept.
    """
    side = {s: F.coalesce(F.col(s), F.array().cast("array<struct<turn:bigint,role:string,text:string>>")) for s in ("chosen", "rejected")}
    rows = pairs.select("conv_id", side["chosen"].alias("chosen"), side["rejected"].alias("rejected"))
    both = F.least(F.array_size("chosen"), F.array_size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), both), F.slice("rejected", F.lit(1), both), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    rows = rows.withColumn("_p", F.when(first == 0, both).otherwise(first - 1).cast("int"))
    out = [F.col("conv_id"), F.col("_p").alias("prompt_turns"), _text(F.slice("chosen", F.lit(1), F.col("_p"))).alias("prompt")]
    for s in ("chosen", "rejected"):
        rest = F.slice(s, F.col("_p") + 1, F.greatest(F.array_size(s) - F.col("_p"), F.lit(0)))
        out += [_text(rest).alias(f"{s}_completion"), _mask(rest).alias(f"{s}_mask")]
    return rows.select(*out)


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def _mask(turns: Column) -> Column:
    """Walks the turns with the length so far, keeping the spans of assistant turns."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(kind)

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])
