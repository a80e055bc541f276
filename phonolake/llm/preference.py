"""Preference formatting, with built-in functions only.

Chosen and rejected conversations of a pair are compared turn by turn; their longest common prefix of turns is rendered
once as the prompt, the rest of each side as its completion. A completion carries a loss mask: the character spans
[start, end) of what the assistant says, end mark included; all else, headers and other roles, is not trained on.

Turns meet by (pair, place): the first place where the sides differ, or one has ended, is a grouped minimum, so only what
is rendered is ever gathered, one training example a row.

Edge cases: null roles and texts count as empty; turns that repeat a place stay, ordered by role and text, and both sides
number their turns anew; a side without turns has an empty completion; equal sides give two empty completions; a null
pair is a pair of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit(CLOSE + "\n"))


def _completion(turns: str, base: str = "0") -> str:
    """Spans of the assistant's words in the joined pieces: each piece starts where the ones before it end."""
    return f"""aggregate({turns}, struct(CAST({base} AS BIGINT) AS at, CAST(array() AS ARRAY<STRING>) AS spans),
        (a, t) -> struct(a.at + length(t.piece) AS at,
            IF(t.role = 'assistant',
               concat(a.spans, array(concat_ws(':', a.at + t.head, a.at + length(t.piece) - 1))), a.spans) AS spans),
        a -> array_join(a.spans, ','))"""


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side ('chosen' or 'rejected'), turn, role, text) -> one row per pair: pair_id, prompt_turns, prompt,
    chosen, rejected, chosen_mask, rejected_mask, chosen_turns, rejected_turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), role, text)
    placed = turns.select(
        "pair_id", "side", role.alias("role"), rendered(role, text).alias("piece"), F.length(header(role)).alias("head"),
        F.row_number().over(order).alias("place"))
    at = (
        placed.groupBy("pair_id", "place")
        .agg(F.count(F.lit(1)).alias("sides"), F.min("piece").alias("a"), F.max("piece").alias("b"))
        .groupBy("pair_id").agg(F.min(F.when((F.col("sides") < 2) | (F.col("a") != F.col("b")), F.col("place"))).alias("differ"))
        .select(F.col("pair_id").alias("_p"), "differ")
    )
    cut = placed.join(at, F.col("pair_id").eqNullSafe(F.col("_p"))).drop("_p").withColumn(
        "part", F.when(F.col("differ").isNotNull() & (F.col("place") >= F.col("differ")), F.col("side"))
        .when(F.col("side") == "chosen", F.lit("prompt")))  # the prefix is rendered from one side only
    gather = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("place", "piece", "role", "head"))))
    whole = cut.groupBy("pair_id").agg(*[gather(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    joined = lambda part: F.expr(f"array_join(transform({part}, t -> t.piece), '')")
    count = lambda part: F.size(part).cast("long")
    return whole.select(
        "pair_id", count("prompt").alias("prompt_turns"), joined("prompt").alias("prompt"), joined("chosen").alias("chosen"),
        joined("rejected").alias("rejected"), F.expr(_completion("chosen")).alias("chosen_mask"),
        F.expr(_completion("rejected")).alias("rejected_mask"), count("chosen").alias("chosen_turns"),
        count("rejected").alias("rejected_turns"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations(conv_id, turn, role, text): the conversation as it is, against itself
    with its last assistant turn replaced by that of its neighbour (conv_id with the lowest bit flipped). Without an
    assistant turn, or without a neighbour that has one, the rejected side ends before the reply."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_n"), F.col("last.text").alias("reply"))
    own = last.select(F.col("conv_id").alias("_c"), F.col("last.turn").alias("at"))
    both = (
        turns.join(own, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
        .join(other, F.col("conv_id") == F.col("_n"), "left").drop("_n")
    )
    reply = F.col("at").eqNullSafe(F.col("turn")) & (F.col("role") == "assistant") & F.col("at").isNotNull()
    chosen = both.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = both.filter(F.coalesce(~reply | F.col("reply").isNotNull(), F.lit(True))).select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role",
        F.when(reply, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return chosen.unionByName(rejected)
