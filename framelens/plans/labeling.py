"""Labeling jobs: user labels, action windows, synthetic labels, slim export, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators import catalog, labels, stats
from framelens.operators.frames import action_window_sum, cutoff_first_valid, cutoff_whole_episode, select_episodes
from framelens.operators.labelers import BatchFunction, LabelPlan, apply_labeler, synthetic_labels
from framelens.session import written
from framelens.sources import datasets


def user_labels(
    frames: DataFrame, plan: LabelPlan, function: BatchFunction, episodes: DataFrame | None = None,
    max_valid: int | None = None,
) -> DataFrame:
    """All source rows with the labels of a user function; fills and valid = 0 elsewhere.

    The function runs once: its output is written before it is counted and joined.
    """
    chosen = select_episodes(frames, episodes)
    found = written(frames.sparkSession, apply_labeler(chosen, plan, function))
    _check_labels(found, chosen, plan)
    fills = {n: r.fill_column() for n, r in plan.representations.items()}
    full = labels.scatter_labels(frames, found, fills)
    return _capped(full, fills, max_valid)


def _check_labels(found: DataFrame, chosen: DataFrame, plan: LabelPlan) -> None:
    """Fail on labels given twice, for frames that were not asked for, or of another size than planned."""
    sizes = {n: r.size for n, r in plan.representations.items() if r.type_name.startswith("array")}
    wrong = [F.count(F.when(F.size(n) != s, 1)).alias(n) for n, s in sizes.items()]
    rows, *counts = found.agg(F.count(F.lit(1)), *wrong).first()
    for (name, size), n in zip(sizes.items(), counts):
        if n:
            raise ValueError(f"{n} labels in {name} do not have the planned size {size}")
    if (distinct := found.select("idx").distinct().count()) != rows:
        raise ValueError(f"{rows - distinct} labels were given more than once for a frame")
    if (stray := found.join(chosen.select("idx"), "idx", "left_anti").count()):
        raise ValueError(f"{stray} labels belong to no frame that was asked for")


def _capped(full: DataFrame, fills: dict, max_valid: int | None) -> DataFrame:
    if max_valid is None:
        return full
    full = cutoff_first_valid(full, max_valid)
    for name, fill in fills.items():
        full = full.withColumn(name, F.when(F.col("valid") == 1, F.col(name)).otherwise(fill))
    return full


def action_window_labels(
    frames: DataFrame, horizon: int, action_dim: int, episodes: DataFrame | None = None, max_valid: int | None = None,
    fill: float = float("nan"),
) -> DataFrame:
    """All source rows with ``label`` = sum of the next actions; no Python worker is needed."""
    chosen = select_episodes(frames, episodes)
    found = action_window_sum(chosen, horizon, action_dim).where("label_valid = 1").select("idx", "label")
    fills = {"label": F.array_repeat(F.lit(fill), action_dim)}
    return _capped(labels.scatter_labels(frames, found, fills), fills, max_valid)


def synthetic_label_table(
    frames: DataFrame, groups: DataFrame, base: dict, shape: tuple[int, ...], seed: int,
    episodes: DataFrame | None = None, max_valid: int | None = None, fill: float = float("nan"),
) -> DataFrame:
    """All source rows with flat ``label`` values by the specification of their episode."""
    size = 1
    for d in shape:
        size *= d
    specified = labels.override_by_episode(select_episodes(frames, episodes), groups, base)
    found = synthetic_labels(specified, (size,), seed).select("idx", "label")
    fills = {"label": F.array_repeat(F.lit(fill).cast("float"), size)}
    return _capped(labels.scatter_labels(frames, found, fills), fills, max_valid)


def slim_export(
    labeled: DataFrame, label_columns: dict[str, tuple[str, tuple[int, ...]]], root: str, dataset: str, prefix: str,
    fps: float, max_valid: int | None = None, force: bool = False,
) -> None:
    """Passthrough and label columns only, whole episodes up to the cutoff, in index order.

    ``label_columns``: column -> (dtype, shape). Contract violations stop the export.
    """
    datasets.check_prefix(prefix)
    kept = labeled if max_valid is None else cutoff_whole_episode(labeled, max_valid)
    renamed = kept.withColumnsRenamed({
        "idx": "index", "valid": f"{prefix}.valid", **{c: f"{prefix}.{c}" for c in label_columns}})
    features = {
        "index": ("int64", (1,), fps), "episode_index": ("int64", (1,), fps), "task_index": ("int64", (1,), fps),
        "frame_index": ("int64", (1,), fps), "timestamp": ("float64", (1,), fps),
    }
    features = {n: v for n, v in features.items() if n in renamed.columns}
    if "action" in renamed.columns:
        features["action"] = ("float64", (renamed.select(F.size("action")).first()[0],), fps)
    for name, (dtype, shape) in label_columns.items():
        features[f"{prefix}.{name}"] = (dtype, shape, fps)
    features[f"{prefix}.valid"] = ("int64", (1,), fps)
    columns = [f"{prefix}.{c}" for c in label_columns] + [f"{prefix}.valid"]
    datasets.write_analysis(renamed, columns, root, dataset, features, fps, force)


def backfill_stats(
    root: str, spark, prefix: str, old: DataFrame | None = None, manifest_names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Recompute label statistics of a stored dataset and merge them over the old ones.

    Returns the merged statistics and the (dataset, stats_feature_names) of the manifest.
    """
    described = datasets.descriptions(spark, [root])
    names = catalog.stats_features(datasets.feature_catalog(described), manifest_names, prefix)
    features = sorted(r["feature"] for r in names.collect())  # the declared label names
    if not features:
        raise ValueError("no floating label features to compute statistics for")
    rows = datasets.scan_frames(spark, root)
    valid = rows.where(F.col(f"`{prefix}.valid`") == 1)
    flat = {}
    for name in features:
        shape = tuple(described.select(F.col("features")[name]["shape"]).first()[0])
        size = 1
        for d in shape:
            size *= d
        column = datasets.coerce_feature(rows, name, "double", (size,))
        flat[name] = F.array(column) if size == 1 else column
    new = stats.feature_stats(valid, flat)
    merged = new if old is None else stats.merge_stats(old, new)
    listed = names.groupBy("dataset").agg(F.array_sort(F.collect_set("feature")).alias("stats_feature_names"))
    return merged, listed
