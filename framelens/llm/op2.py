"""Query op2: all pages through WARC archives and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, warc
from framelens.llm.registry import query

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@query("op2_warc", SQL)
def op2_warc(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("payload", F.encode("html", "UTF-8"))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return warc.round_trip(pages).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", page(F.col("refers_to")).alias("refers_to"))
