"""Samples and train/test splits that depend on keys and a seed only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.hashing import key_slice, random_key
from framelens.operators.ordering import join_by_episode, random_ranks, running_before


def sample_rows(rows: DataFrame, n: int, key: str, seed: int | str) -> DataFrame:
    """At most n rows, uniform without replacement."""
    return random_ranks(rows, key, seed, "_rank", "_total", lambda total: F.lit(n)).drop("_rank", "_total")


def reservoir_sample(rows: DataFrame, capacity: int, key: str, seed: int | str) -> DataFrame:
    """Uniform sample of fixed capacity, in (episode, frame, index) order."""
    return sample_rows(rows, capacity, key, seed).orderBy("episode_index", "frame_index", key)


def held_out(share: float):
    """How many of n units are held out: the ceiling of the share."""
    return lambda total: F.ceil(F.lit(float(share)) * total)


def row_split(rows: DataFrame, n: int | None, test_share: float, key: str, seed: int) -> DataFrame:
    """All rows, or a sample of at most n, with ``side`` = train or test."""
    drawn = random_ranks(fit_sample(rows, n, key, seed), key, f"{seed}-split", "_rank", "_total")
    side = F.when(F.col("_rank") <= held_out(test_share)(F.col("_total")), "test").otherwise("train")
    return drawn.withColumn("side", side).drop("_rank", "_total")


def episodes_to_budget(rows: DataFrame, n: int, seed: int | str) -> DataFrame:
    """Random whole episodes until they hold n rows, at least two; all if n is not reached.

    Fewer than two episodes make the job fail.
    """
    counts = rows.groupBy("episode_index").agg(F.count("*").alias("n_rows"))
    drawn = counts.withColumn("_random", random_key(F.col("episode_index"), seed))
    placed = running_before(
        drawn, ["_random", "episode_index"], key_slice(F.col("_random")),
        {"_rows": F.col("n_rows"), "_one": F.lit(1)}, totals=True,
    )
    enough = F.when(F.col("_one_total") < 2, F.raise_error(F.lit("an episode split needs at least two episodes"))
                    .cast("boolean")).otherwise((F.col("_rows_before") < n) | (F.col("_one_before") < 2))
    return placed.where(enough).select("episode_index", "n_rows")


def split_episodes(episodes: DataFrame, test_share: float, seed: int | str) -> DataFrame:
    """Episodes with ``side``; both sides must be non-empty."""
    ranked = random_ranks(episodes.select("episode_index"), "episode_index", seed, "_rank", "_total")
    held = held_out(test_share)(F.col("_total"))
    empty = (held < 1) | (held >= F.col("_total"))
    side = F.when(empty, F.raise_error(F.lit("the split leaves one side without episodes"))).when(
        F.col("_rank") <= held, F.lit("test")
    ).otherwise(F.lit("train"))
    return ranked.select("episode_index", side.alias("side"))


def episode_split(rows: DataFrame, n: int | None, test_share: float, seed: int) -> DataFrame:
    """Rows of all episodes, or of a budget of them, with ``side``; no episode is on both sides."""
    chosen = rows.select("episode_index").distinct() if n is None else episodes_to_budget(rows, n, seed)
    return join_by_episode(rows, split_episodes(chosen, test_share, f"{seed}-split"), "inner")


def fit_sample(rows: DataFrame, n: int | None, key: str, seed: int | str) -> DataFrame:
    """Rows a model is fitted on; no cap means all rows."""
    return rows if n is None else sample_rows(rows, n, key, seed)
