"""Query op12: Merkle manifest of all documents."""

from __future__ import annotations

from framelens.llm import common, merkle
from framelens.llm.registry import query

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEVELS, GROUP_LEVELS = 8, 4  # rounds that the SQL spells out; a round over one node changes nothing


def _rounds(name: str, keys: str, rounds: int) -> str:
    """SQL: nodes of each round, with place, digests of the others of the run and size of the group."""
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    out = []
    for k in range(rounds):
        out.append(f"""
{name}_runs{k} AS (
  SELECT {keys}, p // 8 AS up, count(*) AS size, string_agg(h, '' ORDER BY p) AS run, any_value(total) AS total FROM {name}_nodes{k} GROUP BY {keys}, p // 8),
{name}_steps{k} AS (
  SELECT n.{', n.'.join(keys.split(', '))}, n.p, n.p % 8 AS place, n.total > 1 AS counts,
         CASE WHEN n.total > 1 THEN substr(run, 1, CAST(64 * (n.p % 8) AS INTEGER)) || substr(run, CAST(64 * (n.p % 8) + 65 AS INTEGER)) ELSE '' END AS others
  FROM {name}_nodes{k} n JOIN {name}_runs{k} r ON {on} AND n.p // 8 = r.up),
{name}_nodes{k + 1} AS (
  SELECT {keys}, up AS p, CASE WHEN total > 1 THEN sha256(run) ELSE run END AS h, count(*) OVER (PARTITION BY {keys}) AS total FROM {name}_runs{k}),""")
    return "".join(out)


def _folds() -> str:
    """SQL: one step after the other from leaf to root."""
    out, names = [], [("doc", "f.p0", k) for k in range(LEVELS)] + [("grp", "f.q0", k) for k in range(GROUP_LEVELS)]
    for i, (name, at, k) in enumerate(names):
        key = "s.lang IS NOT DISTINCT FROM f.lang AND " if name == "doc" else ""
        out.append(f"""
fold{i + 1} AS (
  SELECT f.rid, f.doc_id, f.lang, f.leaf, f.p0, f.q0, f.proof || s.others AS proof,
         CASE WHEN s.counts THEN sha256(substr(s.others, 1, CAST(64 * s.place AS INTEGER)) || f.d || substr(s.others, CAST(64 * s.place + 1 AS INTEGER))) ELSE f.d END AS d
  FROM fold{i} f JOIN {name}_steps{k} s ON {key}s.p = {at} // {8**k}),""")
    return "".join(out)


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


_HEAD = " || ".join(_field(c) for c in FIELDS[:-1])
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_HEAD} AS head, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
hashed AS (
  SELECT rid, doc_id, lang, sha256(head || {_field('text')}) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || {_field(_LOWER)}) END AS changed FROM docs),
doc_nodes0 AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY lang) AS total, rid FROM hashed),
{_rounds("doc", "lang", LEVELS)}
grp_nodes0 AS (
  SELECT 0 AS one, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS p, h, count(*) OVER () AS total, lang FROM doc_nodes{LEVELS}),
{_rounds("grp", "one", GROUP_LEVELS)}
fold0 AS (
  SELECT h.rid, h.doc_id, h.lang, h.leaf, n.p AS p0, g.p AS q0, '' AS proof, coalesce(h.changed, h.leaf) AS d
  FROM hashed h JOIN doc_nodes0 n USING (rid) JOIN grp_nodes0 g ON g.lang IS NOT DISTINCT FROM h.lang),
{_folds()}
whole AS (SELECT h AS root FROM grp_nodes{GROUP_LEVELS})
SELECT f.doc_id, f.leaf, g.h AS subroot, root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM fold{LEVELS + GROUP_LEVELS} f JOIN grp_nodes0 g ON g.lang IS NOT DISTINCT FROM f.lang, whole
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", *FIELDS)
    return merkle.manifest(docs, "doc_id", "lang", FIELDS, "text").withColumnRenamed("id", "doc_id")
