"""Exact quantiles with linear interpolation, for any number of rows per group.

Spark's ``percentile`` keeps all distinct values of a group in one task. Here a group that
is small enough is counted by value and its ranks are read off. In a larger group the wanted
ranks are located first: each pass cuts a cell into parts, counts their rows (only counts are
shuffled) and keeps the few parts that hold a wanted rank, until every part is small or holds
one value. The first cut is by sign and logarithm, so it suits values of any range; in a part,
whose values then lie close together, later cuts are of equal width.

Infinite values are ordered like others; a quantile between two equal values is that value.
A group with a NaN has NaN quantiles. Nulls are ignored, and so are groups with a null key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.operators.ordering import attach, sized
from framelens.session import written

CELL_ROWS = 1_000_000
BINS = 4096
LOG_PARTS = 256  # parts of a factor e in the first cut: at most 800,000 in all
LOG_LOWEST = 745.0  # no number but 0 has a smaller logarithm than -745


def _wanted(n: Column, prob: float) -> Column:
    return F.lit(float(prob)) * (n - 1)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probs: dict[str, float],
    cell_rows: int = CELL_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """One row per key with one column per named probability."""
    spark = df.sparkSession
    keyed = keys or ["_all"]
    base = df.select(*([F.lit(0).alias("_all")] if not keys else keys), value.cast("double").alias("_v"))
    base = base.where(reduce(and_, [F.col(c).isNotNull() for c in (*keyed, "_v")]))
    has_nan = F.max(F.isnan("_v")).alias("_nan")

    lower = [F.floor(_wanted(F.col("_n"), p)).cast("bigint") for p in probs.values()]
    ranks = F.array_distinct(F.array(*lower, *[F.least(r + 1, F.col("_n") - 1) for r in lower]))
    span = base.groupBy(*keyed).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), has_nan)
    span = written(spark, span.withColumn("_ranks", ranks))

    zero = F.lit(0).cast("bigint")
    cells = span.where(~F.col("_nan")).select(*keyed, zero.alias("_c"), "_lo", "_hi", zero.alias("_before"), "_n", "_ranks")
    large = (F.col("_n") > cell_rows) & (F.col("_hi") > F.col("_lo"))
    apart = span.where((F.col("_n") > cell_rows) & (F.col("_nan") | (F.col("_hi") > F.col("_lo")))).select(*keyed)
    n_apart = apart.count()  # at most rows / cell_rows
    located = base.withColumn("_c", zero)
    if n_apart:
        hot, n_hot = _split(spark, base, cells.where(large), keyed, large, bins)
        located = base.join(sized(apart, n_apart), keyed, "left_anti").withColumn("_c", zero).unionByName(
            _locate(base, hot, keyed, n_hot).select(*keyed, "_v", "_c")
        )
        cells = cells.where(~large).unionByName(hot)

    counted = located.groupBy(*keyed, "_c", "_v").agg(F.count("*").alias("_m"))
    running = Window.partitionBy(*keyed, "_c").orderBy("_v")
    ranked = (
        counted.withColumn("_upto", F.sum("_m").over(running))
        .join(cells.select(*keyed, "_c", "_before", "_ranks"), [*keyed, "_c"])
        .withColumn("_end", F.col("_before") + F.col("_upto"))
        .withColumn("_start", F.col("_end") - F.col("_m"))
        .withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_end")))))
    )
    picked = ranked.groupBy(*keyed).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")  # at most 2 per probability
    )
    joined = span.select(*keyed, "_n", "_nan").join(picked, keyed, "left")  # a group with a NaN has no picks
    not_a_number = F.lit(float("nan"))
    return joined.select(*keys, *[F.when(F.col("_nan"), not_a_number).otherwise(_interpolated(p)).alias(name) for name, p in probs.items()])


def _split(spark, base: DataFrame, cells: DataFrame, keys: list[str], large: Column, bins: int) -> tuple[DataFrame, int]:
    """Cut large cells into parts until none is left; the cells and their number."""
    cells, part = written(spark, cells), _log_part()
    while True:
        todo = cells.where(large)
        n = todo.count()
        if not n:
            return cells, cells.count()
        finer = _refine(_locate(base, todo, keys, n), todo, keys, part)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_before")).cast("bigint")  # few cells per key
        cells = written(spark, cells.where(~large).unionByName(finer).withColumn("_c", place))
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)


def _log_part() -> Column:
    """Never decreases with the value; neighbours in a part differ by less than 1/``LOG_PARTS``."""
    size = (F.ln(F.abs("_v")) + LOG_LOWEST) * LOG_PARTS
    return F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.floor(F.signum("_v") * size))


def _locate(base: DataFrame, cells: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows that lie in a cell, with its number and ends; a key has at most two cells per probability."""
    table = sized(cells.select(*keys, "_c", "_lo", "_hi"), rows)
    return base.join(table, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _refine(located: DataFrame, cells: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """Parts of the cells that hold wanted ranks."""
    histogram = located.groupBy(*keys, "_c", part.alias("_b")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    earlier = Window.partitionBy(*keys, "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.col("_before"), F.col("_before") + F.col("_n")
    placed = (
        histogram.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(cells.select(*keys, "_c", F.col("_before").alias("_base"), F.col("_ranks").alias("_wanted")), [*keys, "_c"])
        .withColumn("_before", F.col("_base") + F.col("_earlier"))
        .withColumn("_ranks", F.filter("_wanted", lambda r: (r >= start) & (r < end)))
    )
    return placed.where(F.size("_ranks") > 0).select(*keys, "_c", "_lo", "_hi", "_before", "_n", "_ranks")


def _interpolated(prob: float) -> Column:
    wanted = _wanted(F.col("_n"), prob)
    below = F.floor(wanted).cast("bigint")
    low = F.try_element_at("_at", below)
    high = F.try_element_at("_at", F.least(below + 1, F.col("_n") - 1))
    return F.when((low == high) | (wanted == below), low).otherwise(low + (high - low) * (wanted - below))


def summary(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float] | None = None) -> DataFrame:
    """Per key: count, mean, population std, min, the named quantiles and max."""
    probs = fixed.SUMMARY_QUANTILES if probs is None else probs
    wanted = df.select(*keys, value.cast("double").alias("_value"))
    moments = wanted.groupBy(*keys).agg(
        F.count("_value").alias("count"),
        F.avg("_value").alias("mean"),
        F.stddev_pop("_value").alias("std"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
    )
    quantiles = exact_quantiles(wanted, keys, F.col("_value"), probs)
    return moments.join(quantiles, keys) if keys else attach(moments, quantiles, keys)


def counted_percentile(value: Column, count: Column, prob: float) -> Column:
    """Percentile of a pre-counted table; only for values with few distinct ones.

    Usage counts and tail lengths qualify: n rows have at most sqrt(2 n) distinct counts.
    """
    return F.percentile(value, F.lit(float(prob)), count)
