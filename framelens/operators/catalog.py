"""Checks and choices over the feature catalog of many datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions import fixed


def name_violations(catalog: DataFrame) -> DataFrame:
    """Label features that are stored where windows would be applied to them."""
    return catalog.where(F.col("is_label") & F.col("feature").startswith(fixed.FORBIDDEN_LABEL_PREFIX))


def role_table(spark: SparkSession, prefix: str) -> DataFrame:
    """(role, feature, priority): the alternative names of every role."""
    rows = [
        (role, f"{prefix}.{suffix}", i)
        for role, suffixes in fixed.FEATURE_SUFFIXES.items()
        for i, suffix in enumerate(suffixes)
    ]
    rows += [("valid", f"{prefix}.valid", 0), ("action", "action", 0)]
    return spark.createDataFrame(rows, "role string, feature string, priority bigint")


def resolve_features(catalog: DataFrame, prefix: str) -> DataFrame:
    """Per dataset and role the first existing feature; required roles without one are reported.

    The role table has eight rows, so its broadcast is bounded.
    """
    roles = role_table(catalog.sparkSession, prefix)
    hits = catalog.select("dataset", "feature").distinct().join(F.broadcast(roles), "feature")
    order = Window.partitionBy("dataset", "role").orderBy("priority")
    chosen = hits.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("dataset", "role", "feature")
    needed = catalog.select("dataset").distinct().withColumn(
        "role", F.explode(F.array(*[F.lit(r) for r in fixed.REQUIRED_ROLES]))
    )
    missing = needed.join(chosen, ["dataset", "role"], "left_anti").withColumn("feature", F.lit("missing"))
    return chosen.unionByName(missing)


def stats_features(catalog: DataFrame, manifest_names: DataFrame | None, prefix: str) -> DataFrame:
    """Floating label features per dataset: the manifest's names, else all below the prefix."""
    floating = catalog.where(F.col("dtype").isin(*fixed.FLOATING_DTYPES)).select("dataset", "feature")
    by_prefix = floating.where(F.col("feature").startswith(f"{prefix}.") & ~F.col("feature").endswith(".valid"))
    if manifest_names is None:
        return by_prefix
    named = floating.join(manifest_names.select("dataset", "feature"), ["dataset", "feature"], "left_semi")
    rest = by_prefix.join(manifest_names.select("dataset").distinct(), "dataset", "left_anti")
    return named.unionByName(rest)


def feature_differences(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Names that a dataset declares but lacks, and names it carries without declaring them."""
    keys = ["dataset", "feature"]
    missing = declared.select(*keys).exceptAll(present.select(*keys)).withColumn("problem", F.lit("missing"))
    extra = present.select(*keys).exceptAll(declared.select(*keys)).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)
