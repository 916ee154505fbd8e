"""Statistics of label tensors and usage of label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors
from framelens.operators.ordering import attach, lookup_counted
from framelens.operators.quantiles import counted_percentile, exact_quantiles, summary


def feature_stats(rows: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Long statistics (feature, pos, stat, value) of flat float features over the given rows.

    ``rows`` must hold valid rows only; without rows the result is empty.
    """
    tagged = rows.select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("feature"), tensors.doubles(x).alias("x")) for name, x in features.items()
        ])).alias("f")
    )
    elements = tagged.select("f.feature", F.posexplode("f.x").alias("pos", "v"))
    keys = ["feature", "pos"]
    moments = elements.groupBy(*keys).agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.count("*").cast("double").alias("count"),
    )
    wide = moments.join(exact_quantiles(elements, keys, F.col("v"), fixed.STAT_QUANTILES), keys)
    stats = ["min", "max", "mean", "std", "count", *fixed.STAT_QUANTILES]
    return wide.unpivot(keys, stats, "stat", "value")


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of new features replace the old ones of the same feature."""
    replaced = new.select("feature").distinct()
    return old.join(replaced, "feature", "left_anti").unionByName(new)


def numeric_summary(rows: DataFrame, feature: Column, keys: list[str] | None = None) -> DataFrame:
    """The nine summary statistics over all elements of an array feature."""
    keys = keys or []
    return summary(rows.select(*keys, F.explode(feature).alias("v")), keys, F.col("v"))


def slot_norm_summary(rows: DataFrame, slots: Column) -> DataFrame:
    norms = rows.select(F.posexplode(tensors.slot_norms(slots)).alias("slot_index", "norm"))
    return summary(norms, ["slot_index"], F.col("norm"))


def unique_rows(rows: DataFrame, key: Column) -> DataFrame:
    """Distinct values, values seen once, and the largest multiplicity.

    Equal values compare by value: 0.0 equals -0.0.
    """
    counts = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.count("*").alias("unique_rows"),
        F.count_if(F.col("_n") == 1).alias("singleton_rows"),
        F.max("_n").alias("max_usage"),
    )


def sequence_counts(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Usage count and share of each id sequence."""
    counts = rows.groupBy(ids).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        tensors.sequence_text(F.col(ids)).alias("sequence"), "count", (F.col("count") / total).alias("fraction")
    )


def top_sequences(rows: DataFrame, k: int, ids: str = "ids") -> DataFrame:
    return sequence_counts(rows, ids).orderBy(F.desc("count"), "sequence").limit(k)


def position_counts(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Usage of each token at each position."""
    tokens = rows.select(F.posexplode(ids).alias("position", "token_id"))
    return tokens.groupBy("position", "token_id").agg(F.count("*").alias("count"))


def top_tokens(rows: DataFrame, k: int, ids: str = "ids") -> DataFrame:
    """The k most used tokens of each position; the ranked table holds counts, not rows."""
    order = Window.partitionBy("position").orderBy(F.desc("count"), "token_id")
    return position_counts(rows, ids).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sequence_summary(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Length, distinct, single-use, max, mean and median usage of id sequences."""
    usage = rows.groupBy(ids).agg(F.count("*").alias("usage"))
    by_usage = usage.groupBy("usage", F.size(ids).alias("length")).agg(F.count("*").alias("sequences"))
    return by_usage.agg(
        F.max("length").cast("bigint").alias("sequence_length"),
        F.sum("sequences").alias("unique_sequences"),
        F.coalesce(F.sum(F.when(F.col("usage") == 1, F.col("sequences"))), F.lit(0)).alias("singleton_sequences"),
        F.max("usage").alias("max_usage"),
        (F.sum(F.col("usage") * F.col("sequences")) / F.sum("sequences")).alias("mean_usage"),
        counted_percentile(F.col("usage"), F.col("sequences"), 0.5).alias("median_usage"),
    )


def usage_of_rows(rows: DataFrame, ids: str = "ids", row_key: str = "idx") -> DataFrame:
    """Each row with ``usage_count``: how many rows share its id sequence."""
    counts = rows.groupBy(ids).agg(F.count("*").alias("usage_count"))
    return lookup_counted(rows, counts, ids, "usage_count", row_key)


def distinct_sequences(rows: DataFrame, ids: str = "ids") -> DataFrame:
    return rows.select(ids).distinct().agg(F.count("*").alias("distinct_sequences"))


def histogram(values: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts between min and max; a constant column is spread around its value.

    ``keys`` name slots or formats, of which the declared shape allows few.
    """
    span = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_hi") == F.col("_lo")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    span = span.select(*keys, lo.alias("_lo"), hi.alias("_hi"))
    joined = attach(values, span, keys)
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bin_id = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("bigint")
    return joined.groupBy(*keys, bin_id.alias("bin")).agg(F.count("*").alias("count"))
