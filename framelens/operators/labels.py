"""Attach label rows to frames and check the contract between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators.ordering import join_by_episode


def scatter_labels(frames: DataFrame, labels: DataFrame, fills: dict[str, Column], valid: str = "valid") -> DataFrame:
    """Full-length table: label rows by ``idx``, the fill value and valid = 0 elsewhere."""
    marked = labels.select("idx", *fills, F.lit(1).cast("bigint").alias("_hit"))
    joined = frames.drop(*fills, valid).join(marked, "idx", "left")
    for name, fill in fills.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), fill))
    return joined.withColumn(valid, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


def expand_compact(frames: DataFrame, labels: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """Labels of valid rows only -> all rows; the fill stands where the row is not valid."""
    joined = frames.join(labels.select("idx", *fills), "idx", "left")
    for name, fill in fills.items():
        joined = joined.withColumn(name, F.when((F.col("valid") == 1), F.col(name)).otherwise(fill))
    return joined


def contract_violations(frames: DataFrame, labels: DataFrame, group: str = "episode_index") -> DataFrame:
    """Per group: valid rows, label rows, labels on rows that are not valid, valid rows without a label."""
    side = labels.select("idx", F.lit(1).alias("_label"))
    joined = frames.select(group, "idx", "valid").join(side, "idx", "left")
    has = F.col("_label").isNotNull()
    return joined.groupBy(group).agg(
        F.sum("valid").alias("n_valid"),
        F.sum(has.cast("bigint")).alias("n_labels"),
        F.sum((has & (F.col("valid") != 1)).cast("bigint")).alias("stray_labels"),
        F.sum((~has & (F.col("valid") == 1)).cast("bigint")).alias("missing_labels"),
    )


def mask_disagreements(masks: DataFrame, mask_columns: list[str]) -> DataFrame:
    """Rows jointly valid, and rows on which the validity masks of the formats disagree."""
    first = F.col(mask_columns[0])
    differs = reduce(lambda a, b: a | b, [~F.col(m).eqNullSafe(first) for m in mask_columns[1:]], F.lit(False))
    every = reduce(lambda a, b: a & b, [F.col(m) for m in mask_columns])
    return masks.agg(
        F.sum(every.cast("bigint")).alias("jointly_valid"),
        F.sum(differs.cast("bigint")).alias("disagreeing_rows"),
        F.count("*").alias("n_rows"),
    )


def alignment_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, on one side only, and the row counts of both sides."""
    a = left.select(F.col(key), F.lit(1).alias("_l"))
    b = right.select(F.col(key), F.lit(1).alias("_r"))
    joined = a.join(b, key, "full_outer")
    return joined.agg(
        F.sum((F.col("_l").isNotNull() & F.col("_r").isNotNull()).cast("bigint")).alias("matched"),
        F.sum((F.col("_r").isNull()).cast("bigint")).alias("left_only"),
        F.sum((F.col("_l").isNull()).cast("bigint")).alias("right_only"),
    )


def aligned_pairs(past: DataFrame, future: DataFrame) -> DataFrame:
    """One-to-one pairing on (idx, episode_index)."""
    return past.join(future, ["idx", "episode_index"])


def pairing_mismatches(past: DataFrame, future: DataFrame) -> DataFrame:
    """Rows whose index has no partner, or whose partner lies in another episode."""
    a = past.select("idx", F.col("episode_index").alias("past_episode"))
    b = future.select("idx", F.col("episode_index").alias("future_episode"))
    joined = a.join(b, "idx", "full_outer")
    column = F.when(F.col("past_episode").isNull() | F.col("future_episode").isNull(), "index").otherwise("episode_index")
    return joined.where(~F.col("past_episode").eqNullSafe(F.col("future_episode"))).withColumn("mismatch", column)


def cast_to_plan(df: DataFrame, plan: dict[str, tuple[str, int]]) -> DataFrame:
    """Cast label columns to declared types; a row with another number of elements fails the job."""
    for name, (type_name, size) in plan.items():
        cast = F.col(name).cast(type_name)
        wrong = F.raise_error(F.lit(f"label {name} does not have {size} elements")).cast(type_name)
        df = df.withColumn(name, F.when(F.col(name).isNull() | (F.size(cast) == size), cast).otherwise(wrong))
    return df


def override_by_episode(frames: DataFrame, groups: DataFrame, base: dict[str, Column]) -> DataFrame:
    """Spec columns of the group that lists the row's episode, else the base spec.

    ``groups`` has one row per listed episode.
    """
    listed = groups.select("episode_index", F.lit(True).alias("_listed"), *base)
    joined = join_by_episode(frames, listed, "left")
    for name, value in base.items():
        joined = joined.withColumn(name, F.when(F.col("_listed"), F.col(name)).otherwise(value))
    return joined.drop("_listed")


def mixed_supervision(labeled: DataFrame, action_only: DataFrame) -> DataFrame:
    """One table of label-supervised and action-supervised rows with routing flags."""
    a = labeled.withColumn("latent_supervision", F.lit(True)).withColumn("action_supervision", F.lit(False))
    b = action_only.withColumn("latent_supervision", F.lit(False)).withColumn("action_supervision", F.lit(True))
    return a.unionByName(b, allowMissingColumns=True)
