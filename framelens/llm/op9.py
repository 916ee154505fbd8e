"""Query op9: benchmark items found in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, decontam
from framelens.llm.registry import query

_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)


def _templates(name: str, source: str, columns: str) -> str:
    """SQL: template words ``c`` and their values ``v`` of every text of a table."""
    return rf"""
{name}_names AS (
  SELECT {columns}, array_to_string(list_transform(p, lambda x, i:
           CASE WHEN i > 1 AND regexp_matches(p[i - 1], '[^\x20\x09-\x0D.!?:]$') THEN regexp_replace(x, '^\p{{Lu}}\p{{L}}+', chr(57345)) ELSE x END), ' ') AS n, t
  FROM (SELECT {columns}, t, string_split(t, ' ') AS p FROM (SELECT {columns}, coalesce(text, '') AS t FROM {source}))),
{name}_words AS (
  SELECT {columns},
         regexp_extract_all(lower(regexp_replace(regexp_replace(n, '[0-9]+(?:[.,][0-9]+)*', chr(57344), 'g'),
                            '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{E002}}\x20\x09-\x0D]+', '', 'g')), '[^\x20\x09-\x0D]+') AS k,
         regexp_extract_all(lower(regexp_replace(t, '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{E002}}\x20\x09-\x0D]+', '', 'g')), '[^\x20\x09-\x0D]+') AS v
  FROM {name}_names),
{name} AS (
  SELECT {columns}, v, list_transform(k, lambda x, i:
           CASE WHEN i > 1 AND x IN ({_UNITS}) AND suffix(k[i - 1], chr(57344)) THEN chr(57346) ELSE x END) AS c FROM {name}_words)"""


CONTAMINATION = rf"""
{_templates("dt", "docs", "rid")},
{_templates("it", "items", "item_id")},
iw0 AS (
  SELECT item_id, i - 1 AS ipos, c[i:i + 5] AS w FROM (SELECT item_id, c, unnest(range(1, len(c) - 4)) AS i FROM it)
  UNION ALL SELECT item_id, 0, c FROM it WHERE len(c) BETWEEN 3 AND 5),
iw1 AS (SELECT item_id, ipos, len(w) AS size, array_to_string(w, ' ') AS win FROM iw0
        WHERE len(list_filter(w, lambda x: NOT regexp_matches(x, '[\x{{E000}}-\x{{E002}}]'))) >= 3),
dw AS (SELECT rid, i - 1 AS dpos, size, array_to_string(c[i:i + size - 1], ' ') AS win
       FROM (SELECT rid, c, size, unnest(range(1, len(c) - size + 2)) AS i FROM dt, (SELECT DISTINCT size FROM iw1))),
iw AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows FROM iw1),
found AS (SELECT rid, dpos, item_id, ipos, size, n_windows, dpos - ipos AS diagonal FROM dw JOIN iw USING (size, win)),
places AS (
  SELECT DISTINCT rid, item_id, diagonal, ipos + o AS place, dpos + o AS dplace FROM found, range(6) r(o) WHERE o < size),
valued AS (
  SELECT p.rid, p.item_id, diagonal, it.v[place + 1] AS item_value, dt.v[dplace + 1] AS doc_value
  FROM places p JOIN dt USING (rid) JOIN it ON it.item_id = p.item_id
  WHERE regexp_matches(dt.c[dplace + 1], '[\x{{E000}}-\x{{E002}}]') AND regexp_matches(it.c[place + 1], '[\x{{E000}}-\x{{E002}}]')),
loose AS (
  SELECT rid, item_id, diagonal FROM (
    SELECT rid, item_id, diagonal, item_value, count(DISTINCT doc_value) AS n FROM valued GROUP BY ALL)
  GROUP BY rid, item_id, diagonal HAVING avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) < 0.8),
held AS (
  SELECT *, CASE WHEN ipos - lag(ipos) OVER (PARTITION BY rid, item_id, diagonal ORDER BY ipos) > 6 THEN 1 ELSE 0 END AS cut
  FROM found f WHERE NOT EXISTS (SELECT 1 FROM loose l WHERE l.rid = f.rid AND l.item_id = f.item_id AND l.diagonal = f.diagonal)),
stretched AS (SELECT *, sum(cut) OVER (PARTITION BY rid, item_id, diagonal ORDER BY ipos ROWS UNBOUNDED PRECEDING) AS stretch FROM held),
runs AS (SELECT rid, item_id, max(ipos) - min(ipos) + max(size) AS run FROM stretched GROUP BY rid, item_id, diagonal, stretch),
longest AS (SELECT rid, item_id, max(run) AS run FROM runs GROUP BY rid, item_id),
covered AS (SELECT rid, item_id, count(DISTINCT ipos) AS n, any_value(n_windows) AS n_windows FROM held GROUP BY rid, item_id),
leaks AS (SELECT rid, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, count(*) AS n_items
          FROM covered JOIN longest USING (rid, item_id) WHERE n >= n_windows * 0.4 OR run >= 13 GROUP BY rid)
"""

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents), items AS (SELECT * FROM benchmark), {CONTAMINATION}
SELECT doc_id, leaks.rid IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM docs LEFT JOIN leaks USING (rid)
"""


@query("op9_decontamination", SQL)
def op9_decontamination(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    items = common.table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontam.contamination(docs, items)
    listed = F.coalesce(F.col("_items"), F.array().cast("array<bigint>"))
    return found.select("doc_id", F.col("_items").isNotNull().alias("contaminated"), F.size(listed).cast("long").alias("n_items"),
                        F.array_join(listed.cast("array<string>"), ",").alias("item_ids"))
