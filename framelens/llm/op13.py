"""Query op13: toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, toxicity
from framelens.llm.registry import query


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"))
