"""Preference formatting: the longest common turn prefix once as prompt, and paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:long,role:string,text:string>"


def _safe(c: Column) -> Column:
    """A text cannot close its own turn: the markers in it are spaced out."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _safe(F.coalesce(t["role"], F.lit("user"))), F.lit("\n"))


TAIL = "<|im_end|>\n"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of what is trained in a rendered completion (code points): the assistant's texts with their end markers."""
    parts = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), (F.length(_safe(t["text"])) + len("<|im_end|>")).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("own")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["head"]
        end = start + p["body"]
        place = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["out"], place)).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(parts, first, step, lambda acc: acc["out"]), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row per pair_id of either side: n_prefix, prompt, both completions and their masks, usable.

    Each side has pair_id, turn, role, text, a row per turn; other columns are
    ignored. Turns go by number, then role and text, so ties and repeated rows
    have one order. Null roles count as user in the rendering, null texts as
    empty; in the comparison null equals null only. A side without turns is
    empty. ``usable`` needs both completions to hold something to train on.
    Rows without pair_id are left out. Only turns of one pair are ever held
    together; texts of any length stay whole.
    """
    def gathered(side: DataFrame, name: str) -> DataFrame:
        one = side.filter("pair_id is not null").select(F.col("pair_id").cast("long").alias("pair_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).cast(TURN).alias("t"))
        return one.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias(name))

    both = gathered(chosen, "c").join(gathered(rejected, "r"), "pair_id", "full")
    empty = F.array().cast(f"array<{TURN}>")
    both = both.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, F.lit(False))
    both = both.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(least).cast("long"))
    after = (F.col("n_prefix") + 1).cast("int")
    both = both.withColumn("ct", F.slice("c", after, F.size("c"))).withColumn("rt", F.slice("r", after, F.size("r")))
    own = lambda turns: F.exists(turns, lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    return both.select(
        "pair_id", "n_prefix", render(F.slice("c", F.lit(1), F.col("n_prefix").cast("int"))).alias("prompt"),
        render(F.col("ct")).alias("chosen"), mask(F.col("ct")).alias("chosen_mask"),
        render(F.col("rt")).alias("rejected"), mask(F.col("rt")).alias("rejected_mask"),
        (own("ct") & own("rt")).alias("usable"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs of conversations 2k (chosen) and 2k + 1 (rejected); a missing one leaves its side empty."""
    turns = conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    return preference_pairs(turns.filter("side = 0"), turns.filter("side = 1"))
