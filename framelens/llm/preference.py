"""Preference pairs as one prompt and two masked completions.

The turns that chosen and rejected conversations share at their start are rendered once, as the
prompt; what follows in each is its completion. A completion comes with segments (length in code
points, 1 where the loss counts): the text of assistant turns counts, headers and other turns
don't.

Defined results: null roles and texts are rendered as empty, and equal each other; two equal
conversations have empty completions; an empty conversation shares nothing; turns with one number
are ordered by role and text; turns without a conversation id form one conversation. A rendered
conversation is one row, as its text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import common

COUNTED = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t), F.lit("\n"))), "")


def segments(turns: Column) -> Column:
    """Per turn: the header (0), the text (1 for the assistant) and the line end (0)."""
    piece = lambda n, loss: F.struct(n.cast("int").alias("length"), loss.cast("int").alias("loss"))
    return F.flatten(F.transform(turns, lambda t: F.array(
        piece(F.length(header(t)), F.lit(0)), piece(F.length(body(t)), F.coalesce(t["role"] == COUNTED, F.lit(False))), piece(F.lit(1), F.lit(0)))))


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both arrays start with."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` plus ``_pair``: n_prompt_turns, prompt, completions and their segments."""
    df = pairs.withColumn("_shared", common_turns(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(F.col(c), F.col("_shared") + 1, F.size(c))
    fields = [F.col("_shared").cast("long").alias("n_prompt_turns"), render(F.slice(F.col(chosen), F.lit(1), F.col("_shared"))).alias("prompt")]
    for name, c in (("chosen", chosen), ("rejected", rejected)):
        turns = F.when(F.size(c) > 0, rest(c)).otherwise(F.col(c))
        fields += [render(turns).alias(name), segments(turns).alias(f"{name}_segments")]
    return df.select(*[df[c] for c in pairs.columns], F.struct(*fields).alias("_pair"))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pairs_of(turns: DataFrame) -> DataFrame:
    """Preference pairs of a table of conversations: ``conv_id``, ``chosen_id``, ``chosen``, ``rejected``.

    Conversations that start with the same turn are answers to one request: the one with the
    smallest id is chosen against each other one. A conversation without such a partner, or the
    smallest itself, gives a pair with two or more assistant turns: chosen is the conversation up
    to its last one, rejected has the assistant's turn before in its place.
    """
    opening = F.sha2(F.to_json(F.get("turns", F.lit(0))), 256)
    whole = common.stored(conversations(turns).withColumn("opening", opening))
    heads, n = common.stored_counted(whole.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    placed = common.join_checked(whole, heads, ["opening"], "left", n)
    follows = F.col("chosen_id").isNotNull() & ~F.col("conv_id").eqNullSafe(F.col("chosen_id"))
    leaders = common.join_checked(whole, heads, ["opening"], "inner", n).where("conv_id = chosen_id").select("chosen_id", F.col("turns").alias("chosen"))
    peers = common.lookup(placed.where(follows).drop("opening"), leaders, ["chosen_id"], "inner")
    peers = peers.select("conv_id", "chosen_id", "chosen", F.col("turns").alias("rejected"))

    numbered = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == COUNTED, i)), lambda i: i.isNotNull())
    own = placed.where(~follows).withColumn("replies", numbered).where(F.size("replies") >= 2)
    last, before = F.element_at("replies", -1), F.element_at("replies", -2)
    own = own.select("conv_id", F.col("conv_id").alias("chosen_id"), F.slice("turns", 1, last + 1).alias("chosen"),
                     F.concat(F.slice("turns", 1, last), F.slice("turns", before + 1, 1)).alias("rejected"))
    return peers.unionByName(own)
