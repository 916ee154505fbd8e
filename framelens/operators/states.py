"""Statistics that merge: states of datasets, kept beside them, instead of rows read again.

A state of a feature position holds the count, mean, sum of squared deviations, smallest and
largest value, and a KLL sketch of the values. States of parts merge into the state of the whole:
moments and extremes exactly (up to rounding), quantiles within ``rank_error`` of their rank. A
state of id sequences or vectors is a theta sketch: exact up to ``2**lg`` different values, beyond
that with a relative standard error of ``2**(-lg / 2)``; such states also give overlaps.
Nulls are not counted; a NaN counts in the moments (which become NaN) and is left out of the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors

SKETCH_SIZE = 512
LG_ENTRIES = 14
STATE = ["n", "mean", "m2", "low", "high", "sketch"]


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Twice the 99 percent bound on the rank error of a sketch of that size."""
    return 2 * 2.296 / size**0.9723


def element_state(elements: DataFrame, keys: list[str], value: Column, size: int = SKETCH_SIZE) -> DataFrame:
    """One state per key of scalar values."""
    rows = elements.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    n = F.count("_v")
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg("_v").alias("mean"), (F.var_pop("_v") * n).alias("m2"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.kll_sketch_agg_double(F.when(~F.isnan("_v"), F.col("_v")), size).alias("sketch"))


def feature_state(rows: DataFrame, features: dict[str, Column], keys: list[str] | None = None, size: int = SKETCH_SIZE) -> DataFrame:
    """States (keys, ``feature``, ``pos``) of flat features over the given rows."""
    keys = keys or []
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), tensors.doubles(x).alias("x")) for name, x in features.items()]))
    elements = rows.select(*keys, named.alias("f")).select(*keys, "f.feature", F.posexplode("f.x").alias("pos", "v"))
    return element_state(elements, [*keys, "feature", "pos"], F.col("v"), size)


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of all parts with the same keys as one; a group has one row per part."""
    own = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own)
    placed = states.where("n > 0").withColumn("_mean", mean)
    spread = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(spread).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(probs: dict[str, float]) -> list[Column]:
    return [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]


def feature_stats(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long statistics (keys, ``feature``, ``pos``, ``stat``, ``value``) of states, as of rows; quantiles are the sketch's."""
    keys = [*(keys or []), "feature", "pos"]
    wide = states.select(*keys, F.col("low").alias("min"), F.col("high").alias("max"), "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"),
                         F.col("n").cast("double").alias("count"), *quantiles(fixed.STAT_QUANTILES))
    return wide.unpivot(keys, ["min", "max", "mean", "std", "count", *fixed.STAT_QUANTILES], "stat", "value")


def numeric_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """The nine summary statistics over all elements of the states with equal keys."""
    return merged(states, keys).select(*keys, F.col("n").alias("count"), "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"),
                                       F.col("low").alias("min"), F.col("high").alias("max"), *quantiles(fixed.SUMMARY_QUANTILES))


# ---- different values --------------------------------------------------------------------------


def distinct_state(rows: DataFrame, value: Column, keys: list[str] | None = None, lg: int = LG_ENTRIES) -> DataFrame:
    """``values`` (a sketch of the different values of an array or scalar) and ``rows`` per key."""
    return rows.groupBy(*(keys or [])).agg(F.theta_sketch_agg(F.xxhash64(value), lg).alias("values"), F.count(F.lit(1)).alias("rows"))


def distinct_union(states: DataFrame, keys: list[str] | None = None, lg: int = LG_ENTRIES) -> DataFrame:
    """States with equal keys as one."""
    return states.groupBy(*(keys or [])).agg(F.theta_union_agg("values", lg).alias("values"), F.sum("rows").alias("rows"))


def distinct_count(sketch: str | Column = "values") -> Column:
    return F.theta_sketch_estimate(sketch)


def overlaps(states: DataFrame, name: str) -> DataFrame:
    """For every pair of states (one row each, few): how many different values they share."""
    other = states.select(F.col(name).alias("other"), F.col("values").alias("_values"))
    pairs = states.join(other, F.col(name) < F.col("other"))
    return pairs.select(name, "other", distinct_count(F.theta_intersection("values", "_values")).alias("shared"))
