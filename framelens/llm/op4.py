"""Query op4: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, secret_scan
from framelens.llm.registry import query


def _kind(number: int, pattern: str, keep: str, group: int = 0) -> str:
    """SQL: matches of a kind with places, from the texts between them."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, {number} AS kind, start, start + size AS stop FROM (
    SELECT rid, i, size, v, gap + sum(gap + size) OVER (PARTITION BY rid ORDER BY i) - gap - size AS start FROM (
      SELECT rid, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(g) AS v,
             unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap
      FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g,
                   regexp_split_to_array(t, '{p}') AS gaps FROM docs)))
  WHERE {keep}"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
candidates AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{secret_scan.CANDIDATE}')) AS v FROM docs),
chars AS (
  SELECT v, s, substr(v, s + o, 1) AS c
  FROM (SELECT v, unnest(range(1, length(v) - 18)) AS s FROM candidates
        WHERE {" AND ".join(f"NOT regexp_matches(v, '{p}')" for p in secret_scan.ALLOWED)}), range(20) r(o)),
bits AS (
  SELECT v, max(h) AS h FROM (
    SELECT v, s, log2(20) - sum(n * log2(n)) / 20 AS h FROM (SELECT v, s, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY v, s) GROUP BY v),
secret AS (SELECT v FROM bits WHERE h >= CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3.2 ELSE 3.9 END),
spans AS ({_kind(0, secret_scan.ASSIGN, "length(v) >= 6", 2)} UNION ALL {_kind(1, secret_scan.ACCESS, "true")}
  UNION ALL {_kind(2, secret_scan.HEX, "true")} UNION ALL {_kind(3, secret_scan.CANDIDATE, "v IN (SELECT v FROM secret)")}),
told AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS word FROM spans),
found AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(word, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
         string_agg(word, ',' ORDER BY start, kind) AS spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (rid)
"""


@query("op4_secret_scan", SQL)
def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "_spans")
    of = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    base = secret_scan.listed(F.filter("_spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("_spans")).alias("spans"))
