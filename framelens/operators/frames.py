"""Time-ordered operators on frame tables.

A frame table has ``episode_index``, ``frame_index`` (0-based, consecutive in an episode),
``action`` (array of doubles) and ``valid`` (0/1); valid rows are a prefix of their episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.operators.ordering import (
    CHUNK_FRAMES,
    COARSE_EPISODES,
    at_offset,
    chunk_of,
    episode_window,
    join_by_episode,
    own_rows,
    positions,
    running_before,
    slice_totals,
    with_halo,
)

EPISODE_ORDER = ["episode_index", "frame_index"]


def valid_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("valid").agg(F.count("*").alias("n_rows"))


def valid_rows(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("valid") == 1)


def distinct_episodes(frames: DataFrame) -> DataFrame:
    return frames.select("episode_index").distinct()


def dataset_totals(frames: DataFrame, fallback_tasks: int = 0) -> DataFrame:
    """Episodes, tasks and rows; tasks come from the description when there is no task column."""
    tasks = F.countDistinct("task_index") if "task_index" in frames.columns else F.lit(fallback_tasks).cast("bigint")
    return frames.agg(
        F.countDistinct("episode_index").alias("total_episodes"),
        tasks.alias("total_tasks"),
        F.count("*").alias("total_frames"),
    )


def episode_tails(frames: DataFrame) -> DataFrame:
    """Invalid rows of every episode."""
    return frames.groupBy("episode_index").agg(F.sum((F.col("valid") == 0).cast("bigint")).alias("tail_rows"))


def tail_summary(frames: DataFrame) -> DataFrame:
    """Min, median, max and the distinct tail lengths.

    Tails are counted by length first: n rows allow at most sqrt(2 n) distinct lengths, so
    the exact median and the set of lengths stay small.
    """
    by_length = episode_tails(frames).groupBy("tail_rows").agg(F.count("*").alias("n_episodes"))
    return by_length.agg(
        F.min("tail_rows").alias("min_tail"),
        F.percentile("tail_rows", F.lit(0.5), F.col("n_episodes")).alias("median_tail"),
        F.max("tail_rows").alias("max_tail"),
        F.array_sort(F.collect_set("tail_rows")).alias("unique_tails"),
    )


def contiguous_runs(rows: DataFrame, order: str, value: str, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Half-open ranges [start, end) of equal ``value`` in the order of a dense integer column."""
    framed = rows.select(F.lit(0).alias("episode_index"), F.col(order).alias("frame_index"), value)
    haloed = with_halo(framed, before=1, chunk=chunk)
    starts = own_rows(haloed.withColumn(
        "_start", (~at_offset(F.col(value), -1).eqNullSafe(F.col(value))).cast("bigint")
    ))
    numbered = _running_starts(starts, [], chunk)
    return numbered.groupBy("_run", value).agg(
        F.min("frame_index").alias("start"), (F.max("frame_index") + 1).alias("end")
    ).drop("_run")


def _running_starts(starts: DataFrame, group: list[str], chunk: int) -> DataFrame:
    """Number the runs opened by ``_start`` along frame_index within the group."""
    tagged = starts.withColumn("_slice", chunk_of(chunk=chunk))
    sums = slice_totals(tagged, group, ["_slice"], {"_starts": F.col("_start")}).select(*group, "_slice", "_starts_before")
    inside = Window.partitionBy(*group, "_slice").orderBy("frame_index")
    return (
        tagged.withColumn("_in", F.sum("_start").over(inside))
        .join(sums, [*group, "_slice"])
        .withColumn("_run", F.col("_starts_before") + F.col("_in"))
        .drop("_slice", "_in", "_starts_before", "_start")
    )


def prefix_violations(frames: DataFrame, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Per episode: valid rows that directly follow an invalid one (must be 0)."""
    previous = at_offset(F.col("valid"), -1)
    flagged = own_rows(
        with_halo(frames.select("episode_index", "frame_index", "valid"), before=1, chunk=chunk).withColumn(
            "_bad", F.coalesce(((F.col("valid") == 1) & (previous == 0)).cast("bigint"), F.lit(0))
        )
    )
    return flagged.groupBy("episode_index").agg(
        F.sum("_bad").alias("violations"),
        F.sum((F.col("valid") == 1).cast("bigint")).alias("n_valid"),
        F.count("*").alias("n_rows"),
    )


def window_values(
    frames: DataFrame, feature: str, offsets: Sequence[int], chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Per anchor frame the feature at each offset of its episode and a padding flag per offset.

    The arrays ``window`` and ``is_pad`` follow the order of ``offsets``; padding is null.
    """
    haloed = with_halo(frames, before=max(0, -min(offsets)), after=max(0, max(offsets)), chunk=chunk)
    seen = haloed.select(
        "*",
        *[at_offset(F.struct(F.col(feature).alias("v")), n).alias(f"_at{i}") for i, n in enumerate(offsets)],
    )
    hits = [F.col(f"_at{i}") for i in range(len(offsets))]
    return own_rows(
        seen.withColumn("window", F.array(*[h["v"] for h in hits]))
        .withColumn("is_pad", F.array(*[h.isNull() for h in hits]))
        .drop(*[f"_at{i}" for i in range(len(offsets))])
    )


def past_future_pairs(frames: DataFrame, feature: str, n: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Feature n frames before, at and n frames after each frame; flags tell padding apart."""
    haloed = with_halo(frames, before=n, after=n, chunk=chunk)
    paired = haloed.withColumn("past", at_offset(F.col(feature), -n)).withColumn("future", at_offset(F.col(feature), n))
    return own_rows(paired).select(
        "idx",
        "episode_index",
        "frame_index",
        "past",
        F.col(feature).alias("current"),
        "future",
        F.col("past").isNotNull().alias("past_valid"),
        F.col("future").isNotNull().alias("future_valid"),
    )


def current_action(frames: DataFrame) -> DataFrame:
    return valid_rows(frames).select("idx", "episode_index", "frame_index", "action")


def future_action_mean(
    frames: DataFrame, future_frames: int, action_dim: int, chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Valid rows with ``future_mean``: the mean action over frames t+1 .. t+F.

    A valid row without F later frames makes the job fail.
    """
    if future_frames <= 0:
        raise ValueError("the number of future frames must be positive")
    ahead = episode_window().rangeBetween(1, future_frames)
    haloed = with_halo(frames, after=future_frames, chunk=chunk)
    summed = haloed.withColumn("_n", F.count("frame_index").over(ahead))
    for d in range(action_dim):
        summed = summed.withColumn(f"_s{d}", F.sum(F.col("action")[d]).over(ahead))
    mean = F.array(*[F.col(f"_s{d}") / F.lit(float(future_frames)) for d in range(action_dim)])
    short = F.raise_error(F.lit("episode is too short for its valid rows and the future window"))
    return (
        valid_rows(own_rows(summed))
        .withColumn("future_mean", F.when(F.col("_n") == future_frames, mean).otherwise(short))
        .drop("_n", *[f"_s{d}" for d in range(action_dim)])
    )


def action_window_sum(frames: DataFrame, horizon: int, action_dim: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """All rows with ``label`` = sum of the action over t .. t+H-1 and ``label_valid``.

    Rows whose window leaves the episode are invalid and have no label.
    """
    ahead = episode_window().rangeBetween(0, horizon - 1)
    summed = with_halo(frames, after=horizon - 1, chunk=chunk).withColumn("_n", F.count("frame_index").over(ahead))
    for d in range(action_dim):
        summed = summed.withColumn(f"_s{d}", F.sum(F.col("action")[d]).over(ahead))
    whole = F.col("_n") == horizon
    label = F.when(whole, F.array(*[F.col(f"_s{d}") for d in range(action_dim)]))
    return (
        own_rows(summed.withColumn("label", label).withColumn("label_valid", whole.cast("bigint")))
        .drop("_n", *[f"_s{d}" for d in range(action_dim)])
    )


def progress_context(frames: DataFrame, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Valid rows with their 0-based position in the valid prefix and its length."""
    return positions(
        valid_rows(frames), ["episode_index"], chunk_of(chunk=chunk), ["frame_index"], "progress", "valid_len"
    )


def progress_bin(progress: Column, length: Column, bins: int) -> Column:
    if bins < 1:
        raise ValueError("the number of progress bins must be at least 1")
    share = progress / F.greatest(length - 1, F.lit(1))
    return F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("bigint")


def cutoff_whole_episode(frames: DataFrame, n: int) -> DataFrame:
    """Rows of all episodes up to the one that holds the n-th valid row, tails included.

    The kept episodes are a prefix of the episode order, so the rows are only filtered.
    """
    per_episode = frames.groupBy("episode_index").agg(F.sum("valid").alias("n_valid"))
    coarse = F.floor(F.col("episode_index") / COARSE_EPISODES)
    kept = running_before(per_episode, ["episode_index"], coarse, {"n_valid": F.col("n_valid")})
    last = kept.where(F.col("n_valid_before") < n).agg(F.max("episode_index")).scalar()
    return frames.where(F.col("episode_index") <= last)


def cutoff_first_valid(frames: DataFrame, n: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """All rows; only the first n valid rows of the table order stay valid.

    Only the chunk in which the n-th valid row falls needs a rank of its rows.
    """
    tagged = frames.withColumn("_chunk", chunk_of(chunk=chunk))
    chunks = tagged.groupBy("episode_index", "_chunk").agg(F.sum("valid").alias("_valid"))
    coarse = F.floor(F.col("episode_index") / COARSE_EPISODES)
    before = running_before(chunks, ["episode_index", "_chunk"], coarse, {"_valid": F.col("_valid")})
    inside = Window.partitionBy("episode_index", "_chunk").orderBy("frame_index")
    return (
        tagged.withColumn("_rank", F.sum("valid").over(inside))
        .join(before.select("episode_index", "_chunk", "_valid_before"), ["episode_index", "_chunk"])
        .withColumn(
            "valid",
            F.when((F.col("valid") == 1) & (F.col("_valid_before") + F.col("_rank") <= n), 1).otherwise(0).cast("bigint"),
        )
        .drop("_chunk", "_rank", "_valid_before")
    )


def select_episodes(frames: DataFrame, episodes: DataFrame | None) -> DataFrame:
    """Rows of the listed episodes; no list means all rows."""
    if episodes is None:
        return frames
    return join_by_episode(frames, episodes.select("episode_index"), "left_semi")


def except_episodes(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    return join_by_episode(frames, episodes.select("episode_index"), "left_anti")
