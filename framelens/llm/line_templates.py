"""Line dedup by log templates.

Lines are parsed by a tree of fixed depth: the number of tokens, then the first ``depth``
tokens (all of them in a shorter line), where a token with a digit counts as variable (``<*>``).
A leaf is the set of lines on one path. Inside a leaf a token is constant at its position if at
least two (document, line) pairs and a share of ``field_share`` of all pairs of the leaf have it
there; any other is a value of a variable field and becomes ``<*>``. The share does not depend on
how much data there is, so a template that recurs ten times as often is generalised alike. The line
with these marks is its template; a line that keeps less than ``min_share`` constant tokens is its
own template, with its digits as they are.

Templates found in at least ``min_docs`` documents recur, and so do lines of ``long_tokens`` or
more tokens that stand unchanged in at least two documents. Recurring lines stay in the first
document (smallest id) and are dropped from all others. A line without tokens always stays.

No group is handled by one task: leaves, lines, tokens and templates are counted before the
shuffle, and rows look the counts up, in a broadcast of checked size or in a join whose hot
partitions are split. The outcome does not depend on the order of lines.

Defined results: a document is a pair of id and text, so repeated rows are one document and null
ids are allowed (they come last); a null text is an empty one; an empty line is a line; a line
of any length is one line; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import common

MIN_DOCS = 5
DEPTH = 3
LONG_TOKENS = 8
FIELD_SHARE = 0.1
MIN_SHARE = 0.5
VARIABLE = "<*>"


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def document_lines(docs: DataFrame, id: str, text: str, depth: int) -> DataFrame:
    """A row per line with tokens: document, number, tokens, and the hash of its leaf."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(id).alias("_id"), F.xxhash64(value).alias("_th"), F.posexplode_outer(F.split(value, "\n")).alias("line_no", "_raw"))
    lines = lines.withColumn("_tokens", common.words(F.col("_raw"))).where(F.size("_tokens") > 0)
    leaf = F.xxhash64(F.size("_tokens"), F.array_join(masked(F.slice("_tokens", 1, depth)), " "))
    return lines.select("_id", "_th", "line_no", "_raw", "_tokens", leaf.alias("leaf"))


def _smallest(document: list[str]) -> Column:
    return F.struct(F.col(document[0]).isNull().alias("none"), F.col(document[0]).alias("id"), F.col(document[1]).alias("th"))


def recurring_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
                    long_tokens: int = LONG_TOKENS, field_share: float = FIELD_SHARE, min_share: float = MIN_SHARE) -> DataFrame:
    """Per document (``_id``, ``_th``) the numbers of the lines to drop; documents without any are absent."""
    document = ["_id", "_th"]
    order = _smallest(document)
    lines = document_lines(docs, id, text, depth)
    same = F.when(F.size("_tokens") >= long_tokens, F.unhex(F.md5(F.array_join("_tokens", " "))))
    narrow = common.stored(lines.select(*document, "line_no", "leaf", same.alias("same")))

    # Long lines that stand unchanged in two documents or more.
    exact = narrow.where("same is not null").groupBy("same").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    exact, n_exact = common.stored_counted(exact.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    unchanged = common.join_checked(narrow.where("same is not null").select(*document, "line_no", "same"), exact, ["same"], "inner", n_exact)
    unchanged = unchanged.where(~order.eqNullSafe(F.col("first"))).select(*document, "line_no")

    # Templates of the leaves that enough documents share.
    leaves = narrow.select("leaf", *document).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    leaves, n_leaves = common.stored_counted(leaves.select("leaf"))
    live = common.join_checked(lines, leaves, ["leaf"], "left_semi", n_leaves)
    line = F.when(F.col("_raw").rlike("[0-9]"), F.array_join(masked(F.col("_tokens")), " ")).otherwise(F.array_join("_tokens", " "))
    live = live.select(*document, "line_no", "leaf", line.alias("line"), F.md5(F.concat(F.lit("="), F.array_join("_tokens", " "))).alias("raw"))
    live = common.stored(live.withColumn("kind", F.unhex(F.md5("line"))))  # a line determines its leaf

    kinds = live.select("kind", "leaf", "line", *document).distinct().groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.first("leaf").alias("leaf"), F.first("line").alias("line"))
    kinds = common.stored(kinds)
    totals, n_totals = common.stored_counted(kinds.groupBy("leaf").agg(F.sum("n_pairs").alias("total")))
    counted = common.join_checked(kinds, totals, ["leaf"], "inner", n_totals)
    tokens = counted.select("kind", "n_pairs", "leaf", "total", F.posexplode_outer(F.split("line", " ")).alias("pos", "token")).where(F.col("pos") >= depth)
    tokens = tokens.select("kind", "n_pairs", "total", "pos", F.xxhash64("leaf", "pos", "token").alias("k"), F.xxhash64("token", "pos", "leaf").alias("l"))
    frequent = tokens.groupBy("k", "l").agg(F.sum("n_pairs").alias("support"), F.max("total").alias("total"))
    frequent = frequent.where((F.col("support") >= 2) & (F.col("support") >= F.col("total") * field_share))
    variable = tokens.join(frequent.select("k", "l"), ["k", "l"], "left_anti").groupBy("kind").agg(F.collect_list("pos").alias("_variable"))

    # The template as its constant tokens with their places.
    parts = kinds.drop("n_pairs").join(variable, "kind", "left").withColumn("_words", F.split("line", " "))
    n = F.size("_words")
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col("_variable"), F.array().cast("array<int>")))
    parts = parts.withColumn("_constant", F.filter(places, lambda i: F.get(F.col("_words"), i) != VARIABLE))
    named = F.transform("_constant", lambda i: F.concat_ws(":", i.cast("string"), F.get(F.col("_words"), i)))
    template = F.when(F.size("_constant") >= n * min_share, F.concat_ws(" ", n.cast("string"), F.array_join(named, " ")))
    templates, n_templates = common.stored_counted(parts.select("kind", F.md5(template).alias("template")))  # null: the line itself, with its digits

    placed = common.join_checked(live, templates, ["kind"], "inner", n_templates)
    placed = common.stored(placed.select(*document, "line_no", F.coalesce("template", "raw").alias("template")))
    found = placed.select("template", *document).distinct().groupBy("template").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(order).alias("first")).where(F.col("n_docs") >= min_docs)
    found, n_found = common.stored_counted(found.drop("n_docs"))
    templated = common.join_checked(placed, found, ["template"], "inner", n_found).where(~order.eqNullSafe(F.col("first")))
    dropped = templated.select(*document, "line_no").unionByName(unchanged)
    dropped = dropped.groupBy(*document).agg(F.collect_set("line_no").alias("_dropped"))
    return common.stored(dropped.withColumn("_n", F.size("_dropped")))


def drop_recurring(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` plus a struct ``_lines``: ``n_lines``, ``n_dropped``, ``kept_text``, ``emptied``.

    ``emptied`` marks a document that had words and lost all of them.
    """
    dropped = recurring_lines(docs, id, text, **options)
    n, held = dropped.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    small = 64 * n + 4 * held <= common.BROADCAST_BYTES
    dropped = dropped.select(F.col("_id").alias("_did"), F.col("_th").alias("_dth"), "_dropped")
    dropped = F.broadcast(dropped) if small else dropped
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_hash_of_text", F.xxhash64(value))
    joined = rows.join(dropped, F.col(id).eqNullSafe(F.col("_did")) & (F.col("_hash_of_text") == F.col("_dth")), "left")
    lines = F.split(value, "\n")
    joined = joined.withColumn("_all_lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all_lines") - 1), F.col("_dropped"))
    kept = F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_all_lines"), i)), "\n"))
    joined = joined.withColumn("_kept_text", kept)
    result = F.struct(
        F.size("_all_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_kept_text").alias("kept_text"),
        (F.col("_dropped").isNotNull() & ~F.col("_kept_text").rlike(common.WORD)).alias("emptied"))
    return joined.select(*docs.columns, result.alias("_lines"))


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """Documents with their remaining text; those that lost all their words to dedup are gone."""
    out = drop_recurring(docs, id, text).where("not _lines.emptied")
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("_lines.kept_text").alias(c))
        elif c == length and dict(docs.dtypes)[c] in ("bigint", "int"):
            size = F.length("_lines.kept_text").cast(dict(docs.dtypes)[c])
            columns.append(F.when(F.col("_lines.n_dropped") > 0, size).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
