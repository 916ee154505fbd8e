"""Query op7: preference pairs of all conversations, rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.llm import common, preference
from framelens.llm.registry import query


def _render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), ''), '')"


def _segments(turns: str) -> str:
    return (f"coalesce(array_to_string(list_transform({turns}, lambda t: (length(coalesce(t.role, '')) + 5) || ':0,' || length(coalesce(t.text, '')) || ':' || "
            "CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END || ',1:0'), ','), '')")


SQL = f"""
WITH whole AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id),
placed AS (SELECT *, min(conv_id) OVER (PARTITION BY turns[1]) AS chosen_id FROM whole),
replies AS (
  SELECT *, list_filter(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN i END), lambda i: i IS NOT NULL) AS r FROM placed),
pairs AS (
  SELECT p.conv_id, p.chosen_id, c.turns AS chosen, p.turns AS rejected FROM placed p JOIN placed c ON c.conv_id = p.chosen_id
  WHERE p.conv_id IS DISTINCT FROM p.chosen_id
  UNION ALL
  SELECT conv_id, conv_id, turns[1:r[-1]], list_concat(turns[1:r[-1] - 1], [turns[r[-2]]]) FROM replies
  WHERE conv_id IS NOT DISTINCT FROM chosen_id AND len(r) >= 2),
shared AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: i > least(len(chosen), len(rejected))
            OR chosen[i] IS DISTINCT FROM rejected[i])), len(chosen) + 1) - 1 AS n FROM pairs)
SELECT conv_id, chosen_id, CAST(n AS BIGINT) AS n_prompt_turns, sha256({_render("chosen[1:n]")}) AS prompt_sha256,
       sha256({_render("chosen[n + 1:]")}) AS chosen_sha256, sha256({_render("rejected[n + 1:]")}) AS rejected_sha256,
       {_segments("chosen[n + 1:]")} AS chosen_segments, {_segments("rejected[n + 1:]")} AS rejected_segments
FROM shared
"""


@query("op7_preference", SQL)
def op7_preference(spark, sf_dir):
    turns = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    made = preference.format_pairs(preference.pairs_of(turns))
    text = lambda c: F.sha2(F.col(f"_pair.{c}"), 256)
    listed = lambda c: F.array_join(F.transform(F.col(f"_pair.{c}"), lambda s: F.concat_ws(":", s["length"].cast("string"), s["loss"].cast("string"))), ",")
    return made.select("conv_id", "chosen_id", "_pair.n_prompt_turns", text("prompt").alias("prompt_sha256"), text("chosen").alias("chosen_sha256"),
                       text("rejected").alias("rejected_sha256"), listed("chosen_segments").alias("chosen_segments"), listed("rejected_segments").alias("rejected_segments"))
