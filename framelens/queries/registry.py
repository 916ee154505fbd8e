"""Registration of queries with their SQL checks, and the views that both sides share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = """
WITH ev AS (
  SELECT event_id AS idx, user_id AS episode_index, CAST(length(event_type) AS BIGINT) AS task_index,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         count(*) OVER (PARTITION BY user_id) AS episode_len,
         value AS a0, CAST(json_extract(props, '$.k') AS DOUBLE) AS a1, CAST(length(event_type) AS DOUBLE) AS a2,
         event_id % (SELECT count(*) FROM embeddings) AS vec_id, ts
  FROM events),
frames AS (
  SELECT *, frame_index / CAST(10 AS DOUBLE) AS "timestamp",
         CAST(CASE WHEN frame_index < episode_len - 10 THEN 1 ELSE 0 END AS BIGINT) AS valid
  FROM ev),
lat0 AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
lat1 AS (
  SELECT *, list_transform(range(0, 4), lambda s: CAST(2 * CAST(e[16*s+1] > 0 AS INT) + CAST(e[16*s+2] > 0 AS INT) AS BIGINT)) AS ids
  FROM lat0),
lat AS (
  SELECT *, array_to_string(ids, ' ') AS seq,
         flatten(list_transform(ids, lambda t: [CAST((t // 2) * 2 - 1 AS DOUBLE), CAST((t % 2) * 2 - 1 AS DOUBLE)])) AS cbv
  FROM lat1),
lf AS (SELECT f.*, l.label, l.e, l.ids, l.seq, l.cbv FROM frames f JOIN lat l USING (vec_id)),
v AS (SELECT * FROM lf WHERE valid = 1),
fm AS (
  SELECT *,
         avg(a0) OVER w AS f0, avg(a1) OVER w AS f1, avg(a2) OVER w AS f2
  FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
vt AS (
  SELECT m.idx, m.episode_index, m.frame_index, l.ids, l.seq, a0, a1, a2, f0, f1, f2
  FROM fm m JOIN lat l USING (vec_id) WHERE m.valid = 1),
tl AS (
  SELECT idx, episode_index, ids, seq, 'current_action' AS target, d AS dim, [a0, a1, a2][d + 1] AS y FROM vt, range(3) r(d)
  UNION ALL
  SELECT idx, episode_index, ids, seq, 'future_action_mean', d, [f0, f1, f2][d + 1] FROM vt, range(3) r(d))
"""


def with_views(body: str) -> str:
    """A check that uses the shared views; ``body`` may open further ones with a leading comma."""
    return VIEWS + body


# Means of two-decimal values over 32, 64, ... rows end exactly between two six-decimal
# numbers, where the last bit of a sum decides. Both sides move such ties by the same amount.
NUDGE = 1e-9


def nudged(sql: str) -> str:
    """``round(x, 6)`` -> ``round(x + 1e-9, 6)``, at every depth."""
    out, i = [], 0
    for start in [m.end() for m in re.finditer(r"(?<![A-Za-z_])round\(", sql)]:
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[start : end - 1].endswith(", 6"):
            out.append(end - 4)
    parts = []
    for cut in sorted(out):
        parts.append(sql[i:cut])
        i = cut
    return f" + {NUDGE!r}".join([*parts, sql[i:]])


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = nudged(with_views(sql) if views else sql)
        return fn

    return add


def r6(column: Column | str) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(NUDGE), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


SUMMARY_COLUMNS = ("mean", "std", "min", "p01", "p05", "median", "p95", "p99", "max")


def summary_sql(v: str, quantiles: dict[str, float] | None = None) -> str:
    from framelens.functions.fixed import SUMMARY_QUANTILES

    quantiles = SUMMARY_QUANTILES if quantiles is None else quantiles
    qs = ", ".join(f"round(quantile_cont({v}, {p}), 6) AS {n}" for n, p in quantiles.items())
    return (
        f"count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, "
        f"round(min({v}), 6) AS min, round(max({v}), 6) AS max, {qs}"
    )
