"""Query op6: repeated byte strings removed from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, suffix_dedup
from framelens.llm.registry import query


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    out = suffix_dedup.drop_repeats(docs)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
