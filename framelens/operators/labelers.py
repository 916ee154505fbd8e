"""User batch functions over windows, and synthetic labels from a specification.

A user function gets pandas batches of the declared input columns and returns rows of the
declared output columns; Spark cuts the batches, so the function keeps no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed, hashing, tensors
from framelens.operators.frames import window_values
from framelens.operators.ordering import CHUNK_FRAMES

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Representation:
    """Declared form of one label: Spark type of the flat value, its size, and the fill."""

    type_name: str
    size: int
    fill: float | int

    def fill_column(self) -> Column:
        return F.array_repeat(F.lit(self.fill), self.size).cast(self.type_name)


@dataclass(frozen=True)
class LabelPlan:
    """Window offsets per feature (in frames) and the labels that the function returns."""

    windows: dict[str, list[int]]
    representations: dict[str, Representation] = field(default_factory=dict)

    def output_schema(self) -> str:
        labels = ", ".join(f"`{n}` {r.type_name}" for n, r in self.representations.items())
        return f"idx bigint, {labels}"


def _in_batches(function: BatchFunction, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = function(pdf)
                if set(out.columns) != set(names):
                    raise ValueError(f"the labeler returned {sorted(out.columns)}, expected {sorted(names)}")
                yield out[names]

    return run


def apply_labeler(frames: DataFrame, plan: LabelPlan, function: BatchFunction, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Label rows (idx and the declared labels) of the rows the function accepts.

    The function sees ``<feature>`` (list of window values) and ``<feature>_is_pad`` per row
    and returns one row per valid input row.
    """
    rows = frames
    columns = ["idx"]
    for feature, offsets in plan.windows.items():
        rows = window_values(rows, feature, offsets, chunk).drop(feature)
        rows = rows.withColumnsRenamed({"window": feature, "is_pad": f"{feature}_is_pad"})
        columns += [feature, f"{feature}_is_pad"]
    names = ["idx", *plan.representations]
    return rows.select(*columns).mapInPandas(_in_batches(function, names), plan.output_schema())


def apply_pair_encoder(pairs: DataFrame, encoders: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Past and future label per format from (past, current) and (future, current).

    An encoder is a column expression, or a pandas UDF called on the two columns; rows whose
    partner is padding get null labels.
    """
    out = pairs
    for name, encode in encoders.items():
        for side in ("past", "future"):
            out = out.withColumn(
                f"{name}_{side}", F.when(F.col(f"{side}_valid"), encode(F.col(side), F.col("current")))
            )
    return out


def apply_reconstructor(pairs: DataFrame, carry: list[str], function: BatchFunction) -> DataFrame:
    """User reconstructions, one row per pair and format: (carry, target, latent_format, recon)."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*carry).schema.fields]
    schema = ", ".join([*fields, "target array<double>", "latent_format string", "recon array<double>"])
    names = [*carry, "target", "latent_format", "recon"]
    return pairs.mapInPandas(_in_batches(function, names), schema)


def condition_losses(rows: DataFrame, carry: list[str], decoder: BatchFunction, target: str = "target") -> DataFrame:
    """Mean square error of a user decoder under the four token conditions.

    ``rows`` has one token column per condition; the decoder returns one prediction column
    per condition, named alike.
    """
    conditions = list(fixed.CONDITION_COLUMNS)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry, target).schema.fields]
    schema = ", ".join([*fields, *[f"`{c}` array<double>" for c in conditions]])
    decoded = rows.mapInPandas(_in_batches(decoder, [*carry, target, *conditions]), schema)
    return decoded.select(
        *carry,
        *[tensors.mean_square(F.col(c), F.col(target)).alias(fixed.CONDITION_COLUMNS[c]) for c in conditions],
    )


# ---- synthetic labels ----------------------------------------------------------------------


def spec_violations(spec: DataFrame) -> DataFrame:
    """Problems of a label specification table, one row per problem.

    ``spec``: group_id (null for the base), episode (null for the base), mode, and the
    parameters constant_value, mean, std, low, high (null when not given).
    """
    parameters = ["constant_value", "mean", "std", "low", "high"]
    problems = [F.when(~F.col("mode").isin(*fixed.LABEL_MODE_PARAMETERS), F.lit("unsupported mode"))]
    for mode, needed in fixed.LABEL_MODE_PARAMETERS.items():
        for p in parameters:
            if p in needed:
                problems.append(F.when((F.col("mode") == mode) & F.col(p).isNull(), F.lit(f"{mode} requires {p}")))
            else:
                problems.append(F.when((F.col("mode") == mode) & F.col(p).isNotNull(), F.lit(f"unexpected {p} for {mode}")))
    problems.append(F.when((F.col("mode") == "gaussian") & (F.col("std") < 0), F.lit("std must be >= 0")))
    problems.append(F.when((F.col("mode") == "uniform") & (F.col("high") < F.col("low")), F.lit("high must be >= low")))
    problems.append(F.when(F.col("episode") < 0, F.lit("episode must be >= 0")))
    per_row = spec.select("group_id", "episode", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    listed = spec.where(F.col("group_id").isNotNull()).groupBy("episode").agg(
        F.count("*").alias("_n"), F.count_distinct("group_id").alias("_groups"), F.min("group_id").alias("group_id")
    )
    overlaps = listed.where("_groups > 1").select("group_id", "episode", F.lit("assigned to multiple groups").alias("problem"))
    doubled = listed.where("_n > _groups").select("group_id", "episode", F.lit("duplicate episode").alias("problem"))
    return per_row.distinct().unionByName(overlaps).unionByName(doubled)


def synthetic_values(key: Column, size: int, seed: int | str) -> Column:
    """Flat label of ``size`` numbers by the spec columns of the row (mode and parameters)."""
    constant = F.array_repeat(F.col("constant_value"), size)
    gaussian = F.transform(hashing.normal_array(key, size, seed), lambda z: F.col("mean") + F.col("std") * z)
    width = F.col("high") - F.col("low")
    uniform = F.transform(hashing.uniform_array(key, size, seed), lambda u: F.col("low") + width * u)
    return (
        F.when(F.col("mode") == "constant", constant)
        .when(F.col("mode") == "gaussian", gaussian)
        .when(F.col("mode") == "uniform", uniform)
    )


def synthetic_labels(
    specified: DataFrame, shape: tuple[int, ...], seed: int | str, type_name: str = "float", key: str = "idx"
) -> DataFrame:
    """Rows with ``label``, a tensor of the given shape. Random modes need a floating type."""
    size = 1
    for d in shape:
        size *= d
    flat = synthetic_values(F.col(key), size, seed)
    if type_name not in ("float", "double"):
        flat = F.when(F.col("mode") == "constant", flat).otherwise(
            F.raise_error(F.lit("random modes need a floating type")).cast("array<double>")
        )
    flat = flat.cast(f"array<{type_name}>")
    return specified.withColumn("label", tensors.reshape(flat, shape) if len(shape) > 1 else flat)
