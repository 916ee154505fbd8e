"""Query op1: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, near_dups
from framelens.llm.registry import query


@query("op1_near_duplicates")
def op1_near_duplicates(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = near_dups.near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
