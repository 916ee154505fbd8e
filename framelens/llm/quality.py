"""Quality rules with verdicts per host.

A document breaks rules of its own (too few words, too many repeated words, symbols or lines).
Per host and rule, the share of documents that break it is shrunk towards all hosts: the shares
of the hosts fit a beta distribution by its moments, whose pseudo-counts are added to the counts
of the host, so a host with few documents is not judged by them alone. A host whose shrunk share
exceeds ``max_rate`` for any rule fails, and with it all of its documents.

Defined results: a null text has no words and is too short; null hosts form one host; repeated
rows count as often as they occur; an empty table gives an empty result; added columns never
replace columns of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import common

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
SYMBOL_PERCENT = 30
DUP_LINE_PERCENT = 30
MAX_RATE = 0.5
MAX_STRENGTH = 1000.0
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeat", "symbols", "dup_lines")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_quality``: counts of words, symbols, repeats and lines.

    Everything stays in one row: windows of three words are hashed to 64 bits within the
    document, and only documents with an equal pair sort them to find the places.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(common.WORD))
    df = docs.withColumns({"_q_words": common.words(F.col(text)), "_q_lines": lines})
    w, n = F.col("_q_words"), F.size("_q_words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("_q_windows", windows)
    repeats = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    ordered = F.when(repeats, F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_q_sorted", ordered)
    s = F.col("_q_sorted")
    equal = lambda k, other: F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: equal(k, k + 1) | ((k > 0) & equal(k, F.greatest(k - 1, F.lit(0)))))
    places = F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"])))
    df = df.withColumn("_q_places", places)
    p = F.col("_q_places")
    steps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(p.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda acc, x: acc + x))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_q_lines").cast("long").alias("n_lines"),
    )
    return df.select(*[docs[c] for c in docs.columns], counts.alias("_quality"))


def broken(q: Column) -> dict[str, Column]:
    """Which rules a document breaks, from its counts."""
    return {
        "short": q["n_words"] < MIN_WORDS,
        "repeat": q["n_repeat_words"] * 100 > q["n_words"] * REPEAT_PERCENT,
        "symbols": q["n_symbols"] * 100 > q["n_words"] * SYMBOL_PERCENT,
        "dup_lines": q["n_dup_lines"] * 100 > q["n_lines"] * DUP_LINE_PERCENT,
    }


def failed_hosts(flags: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """Hosts (column ``_host``) with a shrunk failure share above ``max_rate`` for any rule.

    ``flags`` has the host and a boolean per rule. Counts are summed before the shuffle, so a
    host with a third of all documents is one row per task there.
    """
    per_host = flags.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_{r}").cast("long")).alias(r) for r in RULES])
    rates = [F.col(r) / F.col("n") for r in RULES]
    moments = per_host.agg(*[F.avg(x).alias(f"m_{r}") for r, x in zip(RULES, rates)],
                           *[F.var_pop(x).alias(f"v_{r}") for r, x in zip(RULES, rates)])
    judged = per_host.crossJoin(F.broadcast(moments))  # moments: one row
    worst = F.lit(False)
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(MAX_STRENGTH), m * (1 - m) / v - 1)))
        strength = F.coalesce(strength, F.lit(MAX_STRENGTH))
        worst = worst | ((F.col(r) + strength * m) / (F.col("n") + strength) > F.lit(max_rate))
    return judged.where(worst).select("_host")


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None,
          max_rate: float = MAX_RATE) -> DataFrame:
    """``keep`` columns of the documents, plus structs ``_quality`` and ``_verdict``.

    ``_verdict`` has ``base_failed`` and ``kept``. The judged columns are stored once in the
    shared folder, because hosts need all documents before any verdict is known.
    """
    keep = docs.columns if keep is None else keep
    seen = features(docs.select(*dict.fromkeys([*keep, host, text])), text)
    rules = broken(F.col("_quality"))
    base = (rules["short"] | rules["repeat"]).alias("_base_failed")
    flagged = common.stored(seen.select(*keep, F.col(host).alias("_host_of"), "_quality",
                                        *[c.alias(f"_{r}") for r, c in rules.items()], base))
    hosts = common.stored(failed_hosts(flagged, "_host_of", max_rate).withColumn("_failed", F.lit(True)))
    rows = flagged.withColumnRenamed("_host_of", "_host").drop(*[f"_{r}" for r in RULES])
    joined = common.join_checked(rows, hosts, ["_host"], "left")
    verdict = F.struct(F.col("_base_failed").alias("base_failed"),
                       (~F.col("_base_failed") & F.col("_failed").isNull()).alias("kept"))
    return joined.select(*keep, "_quality", verdict.alias("_verdict"))


def kept_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judge(docs, host, text).where("_verdict.kept").select(*docs.columns)
