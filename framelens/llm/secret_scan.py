"""Secrets in texts: fixed patterns, and strings whose sliding-window entropy is high.

Places come from the texts between matches: the pattern splits a text into gaps, and running sums
of the lengths of gaps and matches are the starts, in code points. Candidate strings of at least
``WINDOW`` characters of one class (hex, or letters and digits of base 64) slide a window over
their characters: counts are kept and change by the character that leaves and the one that
enters, as does the sum of n log2 n over them, so no window is counted anew. A candidate is a secret when the entropy of
any window reaches the threshold of its class. Words, numbers, UUIDs and other strings of the
allow-list are suppressed.

Defined results: null and empty texts have no spans; spans of different kinds may overlap and
all are kept; repeated rows are rows; a text of any length is scanned whole, in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions.tensors import bound

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs: equal to AKIA[A-Z0-9]+ of at least 20 characters
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.2, 3.9
ALLOWED = (r"^[A-Za-z/_=+-]+$", r"^[0-9/_=+-]+$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
KINDS = ("assign", "access", "hex", "entropy")
BLOCK = 256


def _last(state: Column, value: Column) -> Column:
    return F.struct((state["at"] + value).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))


def _scan(values: Column, start: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(values, F.struct(start.alias("at"), empty.alias("out")), _last)["out"]


def running_sums(values: Column) -> Column:
    """Sums of all values before each one. Blocks keep the cost of appending linear."""
    blocks = F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    zero = F.lit(0).cast("bigint")
    return bound(blocks, lambda bs: F.flatten(F.zip_with(
        bs, _scan(F.transform(bs, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero), _scan)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of structs ``start``, ``end``, ``value`` (a group): leftmost matches that do not overlap."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    fields = F.struct(F.transform(whole, F.length).alias("sizes"), F.transform(gaps, F.length).alias("gaps"),
                      F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))

    def placed(f: Column) -> Column:
        steps = F.zip_with(f["sizes"], F.slice(f["gaps"], 1, F.size(f["sizes"])), lambda s, g: (s + g).cast("bigint"))
        return F.zip_with(F.arrays_zip(f["sizes"].alias("s"), f["gaps"].alias("g"), f["values"].alias("v")), running_sums(steps), lambda z, at: F.struct(
            (at + z["g"]).alias("start"), (at + z["g"] + z["s"]).alias("end"), z["v"].alias("value")))

    found = bound(fields, lambda f: F.filter(placed(f), lambda x: x["value"].isNotNull()))
    return F.when(text.rlike(pattern), found)


def most_entropy(value: Column) -> Column:
    """Bits of the window of the value with the highest entropy, by counts that slide along.

    The state keeps the count of every ASCII character as one letter of a text, at the place of the
    character, and the sum of n log2 n over the counts; a character that leaves or enters changes
    its own letter and two terms of the sum. Other characters count as the last one.
    """
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)])

    def changed(state: Column, c: Column, by: int) -> Column:
        def at(place: Column) -> Column:
            count = F.ascii(F.substring(state["counts"], place, F.lit(1))) - ord("0")
            return bound(count, lambda n: F.struct(
                (state["s"] + F.get(weight, n + by) - F.get(weight, n)).alias("s"),
                F.overlay(state["counts"], F.char(n + by + ord("0")), place, F.lit(1)).alias("counts")))

        return bound(F.least(F.ascii(c), F.lit(127)) + 1, at)

    def slide(cs: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("s"), F.repeat(F.lit("0"), F.lit(128)).alias("counts"))
        head = F.aggregate(F.slice(cs, 1, WINDOW), none, lambda state, c: changed(state, c, 1))

        def step(state: Column, i: Column) -> Column:
            left = bound(state, lambda x: changed(x, F.get(cs, i - 1), -1))
            return bound(bound(left, lambda x: changed(x, F.get(cs, i + WINDOW - 1), 1)), lambda x: F.struct(
                x["s"].alias("s"), x["counts"].alias("counts"), F.least(state["least"], x["s"]).alias("least")))

        n = F.size(cs)
        steps = F.when(n > WINDOW, F.sequence(F.lit(1), n - WINDOW)).otherwise(F.array().cast("array<int>"))
        first = bound(head, lambda h: F.struct(h["s"].alias("s"), h["counts"].alias("counts"), h["s"].alias("least")))
        return F.lit(math.log2(WINDOW)) - F.aggregate(steps, first, step)["least"] / WINDOW

    return bound(F.split(value, ""), slide)


def is_secret(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    needed = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(allowed, F.lit(False)).otherwise(most_entropy(value) >= needed)


def spans(text: Column) -> Column:
    """Sorted array of structs ``start``, ``kind`` (index into ``KINDS``), ``end``."""
    text = F.coalesce(text, F.lit(""))
    kinds = [
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= MIN_VALUE),
        matches(text, ACCESS), matches(text, HEX),
        F.filter(matches(text, CANDIDATE), lambda m: is_secret(m["value"])),
    ]
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def tagged(k: int, found: Column) -> Column:
        return F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))), none)

    return F.array_sort(F.concat(*[tagged(k, found) for k, found in enumerate(kinds)]))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_spans``. One pass, no shuffle."""
    return docs.withColumn("_spans", spans(F.col(text)))
