"""Benchmark decontamination by template canonicalisation.

Texts become templates: a capitalised word inside a sentence is a name, digits are a number, a
unit word right after a number is a unit; each is replaced by one typed placeholder, other words
are lower-cased and lose their punctuation, and every placeholder keeps the place of its word.
Windows of ``WINDOW`` template words of the benchmark are joined by hash with those of all
documents; an item of fewer words has one window, all of it. Hits of one item in one document
that lie on one diagonal (document place minus item place) are an alignment; where it covers
placeholders, each value of the item must go with one value of the document, else the alignment
is dropped. A document is contaminated by an item if the windows left cover at least ``COVERAGE``
of the item's windows, or if those of one alignment cover ``RUN`` consecutive words; so a question
with other numbers or names is caught, as is a long excerpt of a longer item, and a stock phrase
is not.

The benchmark's windows are counted: below the bound they are broadcast, beyond it both sides are
shuffled. Windows with fewer than ``CONSTANT`` plain words are not used. Every document's template
is computed once; documents with hits are stored before their values are looked at.

Defined results: null or short texts have no windows and are clean; an item without windows
matches nothing; null item ids are reported as null inside the list; repeated documents and items
count once per row; an empty benchmark leaves all documents clean; the private-use characters
U+E000 to U+E002 are read as placeholders wherever they stand; a clash of names is impossible, as
documents are reduced to id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import tensors
from framelens.llm import common

WINDOW = 6
CONSTANT = 3
COVERAGE = 0.4
RUN = 13
CONSISTENT = 0.8
NUMBER, NAME, UNIT = "", "", ""
# Fixed list: words that name a unit when a number stands before them.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "miles", "metres", "meters", "mg", "g", "kg", "lb", "pounds", "tons",
         "ml", "l", "litres", "liters", "s", "ms", "min", "h", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
         "percent", "dollars", "euros", "cents", "degrees", "watts", "volts", "kb", "mb", "gb")
_PLAIN = r"[^\p{L}\p{N}\x{E000}-\x{E002}\x20\x09-\x0D]+"


def template(text: Column) -> Column:
    """Template words of a text; every step of the text is computed once."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[^\x20\x09-\x0D.!?:] )\p{Lu}\p{L}+", NAME)
    return tensors.bound(F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER), lambda t: tensors.bound(
        common.words(F.lower(F.regexp_replace(t, _PLAIN, ""))), lambda ts: F.when(t.contains(NUMBER), _with_units(ts)).otherwise(ts)))


def _with_units(words: Column) -> Column:
    return F.transform(words, lambda t, i: F.when((i > 0) & t.isin(*UNITS) & F.coalesce(
        F.get(words, F.greatest(i - 1, F.lit(0))).endswith(NUMBER), F.lit(False)), F.lit(UNIT)).otherwise(t))


def values(text: Column) -> Column:
    """The words that the template words stand for, one for one."""
    return common.words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _PLAIN, "")))


def is_slot(word: Column) -> Column:
    return word.rlike("[-]")


def windows(tokens: str, size: int = WINDOW) -> Column:
    """Hashes of all windows, in order."""
    n = F.size(tokens)
    hashed = (lambda w: F.xxhash64(w)) if size == WINDOW else (lambda w: F.xxhash64(F.lit(size), w))
    return F.when(n < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: hashed(F.slice(F.col(tokens), i, F.lit(size)))))


def benchmark_windows(items: DataFrame, id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored tables: windows (item, its hash, ``ipos``, ``size``, hash, ``n_windows``) and slots (``place``, value)."""
    rows = common.stored(items.select(F.col(id).alias("item_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("item_tag"),
                                      template(F.col(text)).alias("c"), values(F.col(text)).alias("v")))
    found = None
    for size in range(CONSTANT, WINDOW + 1):  # a shorter item has one window of its own length
        own = rows if size == WINDOW else rows.where(F.size("c") == size)
        one = own.select("item_id", "item_tag", "c", F.lit(size).alias("size"), F.posexplode_outer(windows("c", size)).alias("ipos", "h")).where("h is not null")
        found = one if found is None else found.unionByName(one)
    plain = F.size(F.filter(F.slice("c", F.col("ipos") + 1, F.col("size")), lambda t: ~is_slot(t)))
    found = common.stored(found.where(plain >= CONSTANT).select("item_id", "item_tag", "ipos", "size", "h").distinct())
    sizes = found.groupBy("item_id", "item_tag").agg(F.count(F.lit(1)).alias("n_windows"))
    found = found.join(sizes.select(F.col("item_id").alias("_i"), F.col("item_tag").alias("_t"), "n_windows"),
                       F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_tag") == F.col("_t"))).drop("_i", "_t")
    slots = rows.select("item_id", "item_tag", F.posexplode_outer(F.arrays_zip("c", "v")).alias("place", "z"))
    slots = slots.where(is_slot(F.col("z.c"))).select("item_id", "item_tag", "place", F.col("z.v").alias("item_value")).distinct()
    return common.stored(found), common.stored(slots)


def _found(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Stored places where a window of an item stands in a document."""
    sizes = [r.size for r in spans.select("size").distinct().collect()]  # four at most
    out = None
    for size in sorted({WINDOW, *sizes}):
        own = keyed.select("_id", "_th", template(F.col("_text")).alias("c")).withColumn("w", windows("c", size))
        own = own.select("_id", "_th", F.posexplode_outer("w").alias("dpos", "h")).where("h is not null")  # outer: no filter that computes w twice
        met = common.join_checked(own, spans.where(F.col("size") == size), ["h"], "inner").select("_id", "_th", "dpos", "item_id", "item_tag", "ipos", "size", "n_windows")
        out = met if out is None else out.unionByName(met)
    return common.stored(out.distinct())


def _loose(keyed: DataFrame, found: DataFrame, slots: DataFrame) -> DataFrame:
    """Stored alignments in which values of the item go with several values of the document."""
    matched, n = common.stored_counted(found.select("_id", "_th").distinct())
    texts = common.stored(common.join_checked(keyed, matched, ["_id", "_th"], "left_semi", n).dropDuplicates(["_id", "_th"]))
    said = texts.select("_id", "_th", F.arrays_zip(template(F.col("_text")).alias("c"), values(F.col("_text")).alias("v")).alias("z"))
    said = said.select("_id", "_th", F.posexplode("z").alias("dplace", "z")).where(is_slot(F.col("z.c")))
    said, n_said = common.stored_counted(said.select("_id", "_th", "dplace", F.col("z.v").alias("value")))
    alignment = ["_id", "_th", "item_id", "item_tag", "diagonal"]
    over = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    places = found.select("_id", "_th", "item_id", "item_tag", "dpos", "ipos", over.alias("o")).select(
        "_id", "_th", "item_id", "item_tag", (F.col("dpos") - F.col("ipos")).alias("diagonal"), (F.col("ipos") + F.col("o")).alias("place"), (F.col("dpos") + F.col("o")).alias("dplace"))
    wanted = common.stored(common.join_checked(places.distinct(), slots, ["item_id", "item_tag", "place"], "inner"))
    valued = common.join_checked(wanted, said, ["_id", "_th", "dplace"], "inner", n_said)
    pairs = valued.groupBy(*alignment, "item_value").agg(F.countDistinct("value").alias("n"))
    loose = pairs.groupBy(*alignment).agg(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("share"))
    return common.stored(loose.where(F.col("share") < CONSISTENT).select(*alignment))


def hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per contaminated document and item: ``_id``, ``_th`` (hash of the text), ``item_id``,
    ``coverage`` (share of the item's windows) and ``run`` (longest stretch of words on one alignment)."""
    spans, slots = benchmark_windows(items, item_id, item_text)
    keyed = docs.select(F.col(id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), F.col(text).alias("_text"))
    found = _found(keyed, spans)
    alignment = ["_id", "_th", "item_id", "item_tag", "diagonal"]
    held = common.join_checked(found.withColumn("diagonal", F.col("dpos") - F.col("ipos")), _loose(keyed, found, slots), alignment, "left_anti")

    # Windows that touch or overlap cover one stretch of words; an alignment has no more than the item's windows.
    along = Window.partitionBy(*alignment).orderBy("ipos")
    cut = held.withColumn("_cut", F.coalesce((F.col("ipos") - F.lag("ipos").over(along) > WINDOW).cast("int"), F.lit(0)))
    cut = cut.withColumn("_stretch", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = cut.groupBy(*alignment, "_stretch").agg((F.max("ipos") - F.min("ipos") + F.max("size")).alias("run"), F.collect_set("ipos").alias("_ipos"), F.first("n_windows").alias("n_windows"))
    covered = stretches.groupBy("_id", "_th", "item_id", "item_tag").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_ipos")))).alias("n"), F.max("run").alias("run"), F.first("n_windows").alias("n_windows"))
    return covered.where((F.col("n") >= F.col("n_windows") * COVERAGE) | (F.col("run") >= RUN)).select(
        "_id", "_th", "item_id", (F.col("n") / F.col("n_windows")).alias("coverage"), F.col("run").cast("long").alias("run"))


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` plus ``_items``: the sorted ids of the items found, null when clean."""
    found = hits(docs, items, id, text).groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct("item_id"))).getField("item_id").alias("_items"))
    found = common.stored(found)
    rows = docs.withColumns({"_id": F.col(id), "_th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return common.join_checked(rows, found, ["_id", "_th"], "left").select(*docs.columns, "_items")


def kept_documents(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The clean documents, with their own columns only."""
    return contamination(docs, items, id, text).where("_items is null").select(*docs.columns)
