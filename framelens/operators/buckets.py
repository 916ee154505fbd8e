"""Bucket diagnostics: what the rows of one label bucket have in common.

All operators take long tables, so several bucketings and targets run in one job. Columns:
``feature_set`` names the bucketing, ``bucket`` the bucket of a row in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors
from framelens.operators.frames import _running_starts, progress_bin
from framelens.operators.information import clog, entropy_from, mutual_information
from framelens.operators.ordering import CHUNK_FRAMES, attach, lookup_counted, own_rows, running_before, with_halo


def sequence_buckets(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """One bucket per id sequence, numbered densely in the order of the sequences.

    The numbering runs over the distinct sequences in slices of their first two tokens.
    """
    counts = rows.groupBy(ids).agg(F.count("*").alias("bucket_count"))
    coarse = F.struct(F.get(ids, F.lit(0)).alias("a"), F.get(ids, F.lit(1)).alias("b"))
    numbered = running_before(counts, [ids], coarse, {"_id": F.lit(1)})
    return numbered.select(
        ids, F.col("_id_before").alias("bucket"), tensors.sequence_text(F.col(ids)).alias("bucket_label"), "bucket_count"
    )


def assign_sequence_buckets(rows: DataFrame, ids: str = "ids", row_key: str = "idx") -> DataFrame:
    return lookup_counted(rows, sequence_buckets(rows, ids), ids, "bucket_count", row_key)


def action_stats(rows: DataFrame, keys: list[str], target: str, action_dim: int) -> DataFrame:
    """Per bucket: count, share, and mean and population std of every dimension."""
    dims = range(action_dim)
    per_bucket = rows.groupBy(*keys, "bucket").agg(
        F.count("*").alias("count"),
        *[F.avg(F.col(target)[d]).alias(f"mean_a{d}") for d in dims],
        *[F.stddev_pop(F.col(target)[d]).alias(f"std_a{d}") for d in dims],
    )
    totals = per_bucket.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return attach(per_bucket, totals, keys).withColumn("fraction", F.col("count") / F.col("_total")).drop("_total")


def variance_explained(stats: DataFrame, keys: list[str], action_dim: int) -> DataFrame:
    """Per bucketing: usage, and how much variance of each dimension the buckets explain.

    Works on the bucket table alone: the global variance is the within plus the between part.
    """
    long = stats.select(
        *keys, "bucket", "count",
        F.posexplode(F.array(*[
            F.struct(F.col(f"mean_a{d}").alias("mean"), F.col(f"std_a{d}").alias("std")) for d in range(action_dim)
        ])).alias("dim", "s"),
    ).select(*keys, "count", "dim", F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))
    by_dim = [*keys, "dim"]
    n = F.sum("count")
    centre = long.groupBy(*by_dim).agg((F.sum(F.col("mean") * F.col("count")) / n).alias("_centre"))
    spread = attach(long, centre, by_dim).groupBy(*by_dim).agg(
        (F.sum(F.col("std") * F.col("std") * F.col("count")) / n).alias("within"),
        (F.sum((F.col("mean") - F.col("_centre")) ** 2 * F.col("count")) / n).alias("between"),
        (F.sum(F.col("std") * F.col("count")) / n).alias("within_std"),
    )
    total = F.col("within") + F.col("between")
    explained = F.when(total > fixed.VARIANCE_FLOOR, 1.0 - F.col("within") / total).otherwise(F.lit(0.0))
    per_key = spread.withColumn("explained", explained).groupBy(*keys).agg(
        F.avg("explained").alias("mean_variance_explained"),
        F.avg("within_std").alias("mean_within_bucket_std"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "explained"))), lambda s: s["explained"])
        .alias("variance_explained_by_dim"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "within_std"))), lambda s: s["within_std"])
        .alias("within_bucket_std_by_dim"),
    )
    usage = stats.groupBy(*keys).agg(
        F.sum("count").alias("total_rows"),
        F.count("*").alias("active_buckets"),
        F.count_if(F.col("count") == 1).alias("singleton_buckets"),
        F.max("count").alias("max_bucket_usage"),
        (F.max("count") / F.sum("count")).alias("max_bucket_fraction"),
    )
    return attach(usage, per_key, keys)


def bucket_episode_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "bucket", "episode_index").agg(F.count("*").alias("n"))


def episode_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per bucket: distinct episodes, their share of all, the largest share, exp(entropy)."""
    counts = bucket_episode_counts(rows, keys)
    episodes = rows.select("episode_index").distinct().agg(F.count("*")).scalar()
    per_bucket = counts.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique_episodes"),
        F.max("n").alias("_max"),
        F.sum(clog(F.col("n"))).alias("_clog"),
    )
    return (
        per_bucket.withColumn("episode_coverage", F.col("unique_episodes") / F.greatest(episodes, F.lit(1)))
        .withColumn("max_episode_fraction", F.col("_max") / F.col("count"))
        .withColumn("episode_perplexity", F.exp(entropy_from(F.col("count"), F.col("_clog"))))
        .drop("_max", "_clog")
    )


def progress_coverage(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Per bucket: share of the progress bins that occur (needs ``progress``, ``valid_len``)."""
    binned = rows.select(*keys, "bucket", progress_bin(F.col("progress"), F.col("valid_len"), bins).alias("bin"))
    seen = binned.distinct().groupBy(*keys, "bucket").agg(F.count("*").alias("_bins"))
    return seen.select(*keys, "bucket", (F.col("_bins") / F.lit(bins)).alias("progress_bin_coverage"))


def run_lengths(rows: DataFrame, keys: list[str], chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Per bucket: mean and longest run of consecutive frames, and the share of repeats.

    A row opens a run when the frame before it is in another bucket, so a look at the
    previous frame is enough; runs are numbered along the episode, not inside the bucket.
    """
    needed = rows.select(*keys, "bucket", "episode_index", "frame_index")
    if not keys:
        needed = needed.withColumn("_one", F.lit(0))
    group = keys or ["_one"]
    haloed = with_halo(needed, before=1, chunk=chunk)
    w = Window.partitionBy(*group, "episode_index", "_chunk").orderBy("frame_index")
    follows = (F.lag("frame_index").over(w) == F.col("frame_index") - 1) & (F.lag("bucket").over(w) == F.col("bucket"))
    starts = own_rows(haloed.withColumn("_start", F.when(follows, 0).otherwise(1).cast("bigint")))
    numbered = _running_starts(starts, [*group, "episode_index"], chunk)
    runs = numbered.groupBy(*group, "bucket", "episode_index", "_run").agg(F.count("*").alias("length"))
    per_bucket = runs.groupBy(*group, "bucket").agg(
        F.avg("length").alias("mean_run_length"),
        F.max("length").alias("max_run_length"),
        (F.sum(F.col("length") - 1) / F.greatest(F.sum("length") - 1, F.lit(1))).alias("adjacent_repeat_fraction"),
    )
    return per_bucket.drop("_one")


def context_stats(rows: DataFrame, keys: list[str], bins: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """All context statistics of a bucket in one row."""
    by = [*keys, "bucket"]
    stats = episode_stats(rows, keys)
    totals = stats.groupBy(*keys).agg(F.sum("count").alias("_total"))
    stats = attach(stats, totals, keys).withColumn(
        "fraction", F.col("count") / F.col("_total")
    ).drop("_total")
    return stats.join(run_lengths(rows, keys, chunk), by).join(progress_coverage(rows, keys, bins), by)


CONTEXT_MEANS = {
    "episode_coverage": "weighted_mean_episode_coverage",
    "max_episode_fraction": "weighted_mean_max_episode_fraction",
    "episode_perplexity": "weighted_mean_episode_perplexity",
    "mean_run_length": "weighted_mean_run_length",
    "max_run_length": "weighted_max_run_length",
    "adjacent_repeat_fraction": "weighted_adjacent_repeat_fraction",
    "progress_bin_coverage": "weighted_progress_bin_coverage",
}


def context_summary(rows: DataFrame, keys: list[str], bins: int, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Count-weighted means of the context statistics and the bucket-episode NMI; zeros on no rows."""
    stats = context_stats(rows, keys, bins, chunk)
    n = F.sum("count")
    means = stats.groupBy(*keys).agg(
        F.coalesce(n, F.lit(0)).alias("total_rows"),
        F.count("*").alias("active_buckets"),
        *[F.coalesce(F.sum(F.col(c) * F.col("count")) / n, F.lit(0.0)).alias(a) for c, a in CONTEXT_MEANS.items()],
    )
    nmi = mutual_information(bucket_episode_counts(rows, keys), keys, "bucket", "episode_index", "n")
    nmi = nmi.select(*keys, F.col("nmi").alias("bucket_episode_nmi"))
    joined = means.join(nmi, keys, "left") if keys else attach(means, nmi, keys)
    some = F.col("bucket_episode_nmi").isNotNull() & (F.col("total_rows") > 0)
    return joined.withColumn("bucket_episode_nmi", F.when(some, F.col("bucket_episode_nmi")).otherwise(F.lit(0.0)))


def consistency_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per action bucket: how its rows spread over the latent buckets.

    ``pairs`` is counted: (keys, action_bucket, latent_bucket, n). The mass statistic runs
    over the distinct counts of a bucket (at most sqrt(2 n) of them), never over its rows.
    """
    by = [*keys, "action_bucket"]
    base = pairs.groupBy(*by).agg(
        F.sum("n").alias("count"),
        F.count("*").alias("active_latent_buckets"),
        F.max(F.struct(F.col("n").alias("n"), (-F.col("latent_bucket")).alias("b"))).alias("_top"),
        F.sum(clog(F.col("n"))).alias("_clog"),
    )
    h = entropy_from(F.col("count"), F.col("_clog"))
    base = (
        base.withColumn("top_latent_bucket", -F.col("_top.b"))
        .withColumn("top_latent_fraction", F.col("_top.n") / F.col("count"))
        .withColumn("latent_entropy", h)
        .withColumn("latent_perplexity", F.exp(h))
        .drop("_top", "_clog")
    )
    levels = pairs.groupBy(*by, "n").agg(F.count("*").alias("_same"))
    down = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.select(
        *by, "n", "_same",
        F.coalesce(F.sum(F.col("n") * F.col("_same")).over(down), F.lit(0)).alias("_mass"),
        F.coalesce(F.sum("_same").over(down), F.lit(0)).alias("_ranks"),
    ).join(base.select(*by, F.ceil(F.lit(fixed.MASS_SHARE) * F.col("count")).alias("_goal")), by)
    reached = placed.where(
        (F.col("_mass") < F.col("_goal")) & (F.col("_mass") + F.col("n") * F.col("_same") >= F.col("_goal"))
    ).select(
        *by,
        (F.col("_ranks") + F.ceil((F.col("_goal") - F.col("_mass")) / F.col("n"))).cast("bigint")
        .alias("latent_buckets_for_80pct_mass"),
    )
    totals = base.groupBy(*keys).agg(F.sum("count").alias("_total"))
    out = base.join(reached, by)
    return attach(out, totals, keys).withColumn("fraction", F.col("count") / F.col("_total")).drop("_total")


CONSISTENCY_MEANS = {
    "active_latent_buckets": "weighted_mean_active_latent_buckets",
    "top_latent_fraction": "weighted_mean_top_latent_fraction",
    "latent_entropy": "weighted_mean_latent_entropy",
    "latent_perplexity": "weighted_mean_latent_perplexity",
    "latent_buckets_for_80pct_mass": "weighted_mean_latent_buckets_for_80pct_mass",
}


def consistency_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """NMI, both conditional entropies and the count-weighted means of the bucket statistics."""
    stats = consistency_stats(pairs, keys)
    n = F.sum("count")
    means = stats.groupBy(*keys).agg(
        n.alias("total_rows"),
        F.count("*").alias("action_active_buckets"),
        *[(F.sum(F.col(c) * F.col("count")) / n).alias(a) for c, a in CONSISTENCY_MEANS.items()],
    )
    info = mutual_information(pairs, keys, "action_bucket", "latent_bucket", "n")
    info = info.select(
        *keys,
        F.col("nmi").alias("action_latent_nmi"),
        F.greatest(F.col("h_x") - F.col("mi"), F.lit(0.0)).alias("action_given_latent_entropy"),
    )
    latent = pairs.select(*keys, "latent_bucket").distinct().groupBy(*keys).agg(F.count("*").alias("latent_active_buckets"))
    out = means
    for other in (info, latent):
        out = attach(out, other, keys)
    return out.withColumn("latent_given_action_entropy", F.col("weighted_mean_latent_entropy"))


def pair_counts(action_buckets: DataFrame, latent_buckets: DataFrame) -> DataFrame:
    """Joint counts of every action bucketing with every latent bucketing.

    Both sides are long, (idx, kind, bucket); per row the join gives kinds x kinds pairs.
    """
    a = action_buckets.select("idx", F.col("kind").alias("action_target"), F.col("bucket").alias("action_bucket"))
    b = latent_buckets.select("idx", F.col("kind").alias("feature_set"), F.col("bucket").alias("latent_bucket"))
    return a.join(b, "idx").groupBy("action_target", "feature_set", "action_bucket", "latent_bucket").agg(
        F.count("*").alias("n")
    )


def top_rows(table: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows of each result table in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
