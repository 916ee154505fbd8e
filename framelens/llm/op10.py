"""Query op10: line dedup by templates over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, line_templates
from framelens.llm.registry import query

TEMPLATES = r"""
source AS (SELECT rid, doc_id, coalesce(text, '') AS t FROM docs),
raw_lines AS (
  SELECT rid, doc_id, t, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT *, string_split(t, chr(10)) AS ls FROM source)),
masks AS (
  SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw_lines) WHERE len(w) >= 1),
all_lines AS (
  SELECT rid, doc_id, t, line_no, len(m) || ' ' || array_to_string(m[1:3], ' ') AS leaf, array_to_string(m, ' ') AS line,
         array_to_string(w, ' ') AS raw, CASE WHEN len(w) >= 8 THEN array_to_string(w, ' ') END AS same FROM masks),
same_places AS (SELECT rid, line_no, dense_rank() OVER (PARTITION BY same ORDER BY doc_id NULLS LAST, t) AS place FROM all_lines WHERE same IS NOT NULL),
live_leaves AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, t FROM all_lines) GROUP BY leaf HAVING count(*) >= 5),
live AS (SELECT * FROM all_lines WHERE leaf IN (SELECT leaf FROM live_leaves)),
kinds AS (SELECT leaf, line, count(*) AS n_pairs FROM (SELECT DISTINCT leaf, line, doc_id, t FROM live) GROUP BY leaf, line),
toks AS (
  SELECT leaf, line, n_pairs, total, unnest(range(len(ts))) AS pos, unnest(ts) AS token
  FROM (SELECT *, string_split(line, ' ') AS ts, sum(n_pairs) OVER (PARTITION BY leaf) AS total FROM kinds)),
supported AS (SELECT *, sum(n_pairs) OVER (PARTITION BY leaf, pos, token) AS support FROM toks),
marked AS (
  SELECT leaf, line, pos, CASE WHEN pos < 3 OR (support >= 2 AND support >= total * CAST(0.1 AS DOUBLE)) THEN token ELSE '<*>' END AS token FROM supported),
templates AS (
  SELECT leaf, line, CASE WHEN avg(CASE WHEN token = '<*>' THEN 0.0 ELSE 1.0 END) >= 0.5
                          THEN string_agg(token, ' ' ORDER BY pos) END AS template
  FROM marked GROUP BY leaf, line),
placed AS (SELECT rid, doc_id, t, line_no, coalesce(template, '=' || raw) AS template FROM live JOIN templates USING (leaf, line)),
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY template ORDER BY doc_id NULLS LAST, t) AS place FROM placed),
gone AS (
  SELECT rid, line_no FROM (SELECT *, max(place) OVER (PARTITION BY template) AS n_docs FROM ranked)
  WHERE n_docs >= 5 AND place > 1
  UNION SELECT rid, line_no FROM same_places WHERE place > 1),
deduped AS (
  SELECT raw_lines.rid, any_value(raw_lines.doc_id) AS doc_id, count(*) AS n_lines, count(gone.line_no) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY raw_lines.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS kept_text
  FROM raw_lines LEFT JOIN gone USING (rid, line_no) GROUP BY raw_lines.rid)
"""

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents), {TEMPLATES}
SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM deduped
"""


@query("op10_line_templates", SQL)
def op10_line_templates(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_templates.drop_recurring(docs)
    text = F.coalesce(F.col("_lines.kept_text"), F.lit(""))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(text, 256).alias("kept_sha256"))
