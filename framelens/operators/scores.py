"""Scores per row and their summaries: cosine, reconstruction error, ablation loss, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed, tensors, text
from framelens.operators.quantiles import exact_quantiles, summary


def long_scores(rows: DataFrame, carry: list[str], scores: dict[str, Column]) -> DataFrame:
    """Stack score columns of several formats with a ``latent_format`` column."""
    packed = F.array(*[F.struct(F.lit(n).alias("latent_format"), s.alias("spcfc")) for n, s in scores.items()])
    return rows.select(*carry, F.explode(packed).alias("_s")).select(*carry, "_s.latent_format", "_s.spcfc")


def cosine_summary(scores: DataFrame) -> DataFrame:
    return summary(scores, ["latent_format"], F.col("spcfc"))


def cosine_by_episode(scores: DataFrame) -> DataFrame:
    """Per format and episode, with the sample standard deviation (null for one row)."""
    keys = ["latent_format", "episode_index"]
    moments = scores.groupBy(*keys).agg(
        F.count("spcfc").alias("count"),
        F.avg("spcfc").alias("mean"),
        F.when(F.count("spcfc") > 1, F.stddev_samp("spcfc")).alias("std"),
        F.min("spcfc").alias("min"),
        F.max("spcfc").alias("max"),
    )
    return moments.join(exact_quantiles(scores, keys, F.col("spcfc"), {"median": 0.5}), keys)


def reconstruction_metrics(rows: DataFrame, carry: list[str], target: str, formats: dict[str, Column]) -> DataFrame:
    """Per row and format: MSE, MAE and PSNR of flat reconstructions."""
    packed = F.array(*[F.struct(F.lit(n).alias("latent_format"), r.alias("recon")) for n, r in formats.items()])
    long = rows.select(*carry, target, F.explode(packed).alias("_r"))
    return reconstruction_errors(long.select(*carry, target, "_r.latent_format", "_r.recon"), carry, target)


def reconstruction_errors(long: DataFrame, carry: list[str], target: str) -> DataFrame:
    measured = long.select(
        *carry,
        "latent_format",
        tensors.mean_square(F.col("recon"), F.col(target)).alias("mse"),
        tensors.mean_absolute(F.col("recon"), F.col(target)).alias("mae"),
    )
    return measured.withColumn("psnr_db", tensors.psnr(F.col("mse")))


def reconstruction_summary(metrics: DataFrame) -> DataFrame:
    """Per format: display name, count, and mean and median of every metric."""
    names = ["mse", "mae", "psnr_db"]
    long = metrics.unpivot(["latent_format"], names, "metric", "value")
    keys = ["latent_format", "metric"]
    means = long.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"))
    both = means.join(exact_quantiles(long, keys, F.col("value"), {"median": 0.5}), keys)
    wide = both.groupBy("latent_format").agg(
        F.max("count").alias("count"),
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{s}_{m}") for m in names for s in ("mean", "median")],
    )
    return wide.withColumn("display_name", text.display_name(F.col("latent_format")))


def long_losses(losses: DataFrame, carry: list[str]) -> DataFrame:
    """One row per condition, with the baseline loss of the row at hand."""
    baseline = fixed.CONDITION_COLUMNS[fixed.BASELINE_CONDITION]
    packed = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.col(column).cast("double").alias("loss"))
        for c, column in fixed.CONDITION_COLUMNS.items()
    ])
    long = losses.select(*carry, F.col(baseline).cast("double").alias("baseline"), F.explode(packed).alias("_l"))
    return long.select(*carry, "baseline", "_l.condition", "_l.loss")


def described(table: DataFrame) -> DataFrame:
    return table.withColumn("description", text.lookup(F.col("condition"), fixed.CONDITION_DESCRIPTIONS))


def loss_summary(losses: DataFrame) -> DataFrame:
    probs = {n: fixed.SUMMARY_QUANTILES[n] for n in ("p05", "median", "p95")}
    return described(summary(long_losses(losses, []), ["condition"], F.col("loss"), probs))


def loss_comparison(losses: DataFrame) -> DataFrame:
    """Every other condition against the baseline: deltas, ratios and who is worse."""
    long = long_losses(losses, []).where(F.col("condition") != fixed.BASELINE_CONDITION)
    long = long.select(
        "condition",
        (F.col("loss") - F.col("baseline")).alias("delta"),
        (F.col("loss") / F.greatest(F.col("baseline"), F.lit(fixed.RATIO_FLOOR))).alias("ratio"),
    )
    means = long.groupBy("condition").agg(
        F.count("*").alias("count"),
        F.avg("delta").alias("mean_delta_vs_normal"),
        F.avg("ratio").alias("mean_ratio_vs_normal"),
        F.avg((F.col("delta") > 0).cast("double")).alias("fraction_worse_than_normal"),
        F.avg((F.col("delta") < 0).cast("double")).alias("fraction_better_than_normal"),
    )
    deltas = exact_quantiles(long, ["condition"], F.col("delta"), {
        "median_delta_vs_normal": 0.5, "p95_delta_vs_normal": 0.95})
    ratios = exact_quantiles(long, ["condition"], F.col("ratio"), {"median_ratio_vs_normal": 0.5})
    return described(means.join(deltas, "condition").join(ratios, "condition"))


def loss_by_episode(losses: DataFrame) -> DataFrame | None:
    if "episode_index" not in losses.columns:
        return None
    return losses.groupBy("episode_index").agg(*[F.avg(c).alias(c) for c in fixed.CONDITION_COLUMNS.values()])


PROBE_KEYS = ["probe_model", "split_mode", "feature_set", "target"]


def probe_scores(predictions: DataFrame) -> DataFrame:
    """R^2 and MSE of held-out rows per dimension, and their averages over the dimensions.

    ``predictions``: PROBE_KEYS, n_train, action_dim, y, p. A constant target scores 1 when
    it is met exactly and else 0.
    """
    by = [*PROBE_KEYS, "n_train", "action_dim"]
    sums = predictions.groupBy(*by).agg(
        F.count("*").alias("n_test"),
        F.sum((F.col("y") - F.col("p")) ** 2).alias("_res"),
        (F.var_pop("y") * F.count("*")).alias("_tot"),
    )
    r2 = F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).otherwise(
        F.when(F.col("_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    scored = sums.withColumn("r2", r2).withColumn("mse", F.col("_res") / F.col("n_test")).drop("_res", "_tot")
    averages = scored.groupBy(*PROBE_KEYS).agg(
        F.avg("r2").alias("avg_r2_for_target"), F.avg("mse").alias("avg_mse_for_target")
    )
    return scored.join(averages, PROBE_KEYS)


def probe_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*PROBE_KEYS).agg(F.avg("r2").alias("mean_r2"), F.avg("mse").alias("mean_mse"))


def union_probes(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy("probe_model", "feature_set", "target", "action_dim")


def best_probes(summary_table: DataFrame) -> DataFrame:
    """Per model: the row of the best mean R^2 and the row of the best mean MSE."""
    tie = [-F.col("mean_mse"), F.col("mean_r2")]
    row = F.struct("feature_set", "target", "mean_r2", "mean_mse", "split_mode")
    best = summary_table.groupBy("probe_model").agg(
        F.max_by(row, F.struct(F.col("mean_r2"), tie[0])).alias("r"),
        F.max_by(row, F.struct(tie[0], tie[1])).alias("m"),
    )
    return best.select(
        "probe_model",
        F.col("r.split_mode").alias("split_mode"),
        F.col("r.feature_set").alias("best_r2_feature_set"),
        F.col("r.target").alias("best_r2_target"),
        F.col("r.mean_r2").alias("best_mean_r2"),
        F.col("m.feature_set").alias("best_mse_feature_set"),
        F.col("m.target").alias("best_mse_target"),
        F.col("m.mean_mse").alias("best_mean_mse"),
    )


def headline(metrics: DataFrame, wanted: dict[str, tuple[str, ...]], keys: list[str], value: str = "value") -> DataFrame:
    """One row with a column per wanted key combination of a long metric table; null if absent."""
    columns = []
    for name, combination in wanted.items():
        hit = F.lit(True)
        for k, wanted_value in zip(keys, combination, strict=True):
            hit = hit & (F.col(k) == F.lit(wanted_value))
        columns.append(F.max(F.when(hit, F.col(value))).alias(name))
    return metrics.agg(*columns)
