"""Query op11: damaged conversations repaired by cheapest edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, conversations
from framelens.llm.registry import query

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repaired = common.stored(conversations.repair(conversations.damage(rows)))
    every = rows.select("conv_id").distinct().withColumn("ck", conversations.conversation_key(F.col("conv_id")))
    found = every.join(repaired, "ck", "left")  # both sides hold one row per conversation
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
