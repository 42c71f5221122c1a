"""Preference formatting in DataFrame functions alone.

A chosen and a rejected conversation are compared turn by turn. Their longest common prefix of turns (same
place, role and text) is rendered once as the prompt; the turns after it are rendered as the two completions,
each with a mask: the character ranges, counted from the start of the prompt, whose tokens carry loss. Those
are the assistant's texts with their end mark; headers and other roles' turns are masked.

One shuffle brings the turns of a pair together, as one pair is one row of the result; positions are running sums in
that order and all else happens within the row, in time linear in its turns. No task holds more than its pairs, so only a single conversation's own length bounds a task.

Edge cases: turns are ordered by turn, then role, then text, nulls first, and repeated rows count once. A null
role is rendered as "unknown", a null text as empty. Rows without pair id are left out. Identical conversations give a prompt and two
empty completions. A pair that one side lacks gives an empty prompt and an empty completion for that side.
Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: header before a turn's text and mark after it.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
SIDES = ("chosen", "rejected")


def turns(side: DataFrame, name: str) -> DataFrame:
    rows = side.where(F.col("pair_id").isNotNull()).select(F.col("pair_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.distinct().withColumn("side", F.lit(name)).withColumn("length", F.length("role") + F.length("text") + (len(BEGIN) + len(MIDDLE) + len(END)))


def rendered(t: Column) -> Column:
    return F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))


def joined(part: Column) -> Column:
    return F.array_join(F.transform(part, rendered), "")


def mask(part: Column) -> Column:
    """start:end of every trained text with its end mark, comma-joined."""
    trained = F.filter(part, lambda t: t["role"] == TRAINED)
    return F.array_join(F.transform(trained, lambda t: F.concat_ws(":", t["stop"] - F.length(t["text"]) - len(END), t["stop"])), ",")


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask from two frames of turns
    (pair_id, turn, role, text)."""
    both = turns(chosen, SIDES[0]).unionByName(turns(rejected, SIDES[1]))
    # Where a turn ends in its conversation: the prompt is the head of both, so this holds for the completions, too.
    order = Window.partitionBy("pair_id").orderBy("side", "turn", "role", "text")
    run = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    other = F.sum(F.when(F.col("side") == SIDES[0], F.col("length"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("stop", run - F.when(F.col("side") == SIDES[0], F.lit(0)).otherwise(F.coalesce(other, F.lit(0))))
    item = F.struct("turn", "role", "text", "stop")
    gathered = both.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, item))).alias(f"{s}_turns") for s in SIDES))
    # zip_with fills the shorter side with nulls, which equal nothing.
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    gathered = gathered.withColumn("n_prompt_turns", F.when(differs == 0, F.size("chosen_turns")).otherwise(differs - 1))
    n = F.col("n_prompt_turns").cast("int")
    rest = {s: F.slice(F.col(f"{s}_turns"), n + 1, F.size(f"{s}_turns")) for s in SIDES}
    out = gathered.select("pair_id", n.cast("long").alias("n_prompt_turns"), joined(F.slice("chosen_turns", F.lit(1), n)).alias("prompt"), *(rest[s].alias(s) for s in SIDES))
    return out.select("pair_id", "n_prompt_turns", "prompt", *(joined(F.col(s)).alias(s) for s in SIDES), *(mask(F.col(s)).alias(f"{s}_mask") for s in SIDES))


def swapped_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: chosen is conversation c as it is; rejected is c with its last turn's text
    replaced by the last turn's of the next conversation (c + 1), where there is one."""
    base = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = base.groupBy("pair_id").agg(F.max("turn").alias("last"), F.max_by(F.coalesce("text", F.lit("")), F.struct("turn", "role", "text")).alias("other"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), "other")
    swap = last.select("pair_id", "last").join(other, "pair_id", "left")
    rejected = base.join(swap, "pair_id").select("pair_id", "turn", "role", F.when((F.col("turn") == F.col("last")) & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("text")).alias("text"))
    return base, rejected
