"""Query op3: quality rules with host verdicts over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, quality
from framelens.llm.registry import query

VERDICTS = r"""
words AS (
  SELECT rid, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS r FROM twice, range(3) s(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS nl, count(*) - count(DISTINCT line) AS nd
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT words.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(nd, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         coalesce(nl, 0) AS nl
  FROM words LEFT JOIN repeated USING (rid) LEFT JOIN lines USING (rid)),
flags AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1,
         100 * n_symbols > 30 * n_words AS f2, 100 * n_dup_lines > 30 * nl AS f3 FROM counts),
rates AS (
  SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE hit) AS f
  FROM (SELECT host, unnest([0, 1, 2, 3]) AS rule, unnest([f0, f1, f2, f3]) AS hit FROM flags) GROUP BY host, rule),
moments AS (
  SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM rates GROUP BY rule),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(1, least(1000, m * (1 - m) / v - 1)) ELSE 1000 END AS k FROM moments),
bad_hosts AS (SELECT DISTINCT host FROM rates JOIN prior USING (rule) WHERE (f + k * m) / (n + k) > 0.5),
verdicts AS (
  SELECT rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
         NOT (f0 OR f1) AND NOT EXISTS (SELECT 1 FROM bad_hosts b WHERE b.host IS NOT DISTINCT FROM flags.host) AS kept
  FROM flags)
"""

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents), {VERDICTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts
"""


@query("op3_quality_rules", SQL)
def op3_quality_rules(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "source", "text")
    judged = quality.judge(docs, keep=["doc_id"])
    return judged.select("doc_id", *[F.col(f"_quality.{c}") for c in quality.FEATURES], "_verdict.base_failed", "_verdict.kept")
