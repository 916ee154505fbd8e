"""Dataset folders: descriptions, scans, labeled outputs, manifests and result tables.

A dataset is a folder with parquet files under ``data`` and descriptions under ``meta``.
A description is one JSON file; manifests and registries are JSON lines written by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.functions import fixed

FEATURE = "struct<dtype:string,shape:array<bigint>,names:array<string>,fps:double>"
DESCRIPTION = (
    "dataset string, fps double, total_episodes bigint, total_frames bigint, total_tasks bigint, "
    f"chunks_size bigint, splits map<string,string>, analysis_only boolean, features map<string,{FEATURE}>"
)


def passthrough(df: DataFrame) -> DataFrame:
    """The passthrough columns that the source has."""
    return df.select(*[c for c in fixed.PASSTHROUGH_COLUMNS if c in df.columns])


def rename(df: DataFrame, names: dict[str, str] | None) -> DataFrame:
    return df.withColumnsRenamed(names) if names else df


# ---- reading -------------------------------------------------------------------------------


def _root_of(path: Column, inner: str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, f"^(.*)/{inner}(/.*)?$", 1), "^file:(//)?", "")


def descriptions(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Descriptions of many datasets; a description is a JSON file or a folder of JSON parts."""
    found = spark.read.schema(DESCRIPTION).option("multiLine", True).json([f"{r}/meta/info.json" for r in roots])
    return found.withColumn("root", _root_of(F.col("_metadata.file_path"), "meta/info.json"))


def feature_catalog(described: DataFrame) -> DataFrame:
    """One row per (dataset, feature) with its declared type and the totals of the dataset."""
    return described.select(
        *[c for c in described.columns if c != "features"], F.explode("features").alias("feature", "spec")
    ).select(
        *[c for c in described.columns if c != "features"],
        "feature",
        "spec.dtype",
        "spec.shape",
        "spec.names",
        F.col("spec.fps").alias("feature_fps"),
    )


SCALARS = {"int64": T.LongType(), "int32": T.IntegerType(), "float32": T.FloatType(), "float64": T.DoubleType(),
           "bool": T.BooleanType(), "string": T.StringType()}


def declared_schema(features: dict[str, tuple[str, tuple[int, ...], float]]) -> T.StructType:
    """Spark schema of declared features; shape and fps stay in the field metadata."""
    fields = []
    for name, (dtype, shape, fps) in features.items():
        kind = SCALARS[dtype]
        if tuple(shape) != (1,):
            for _ in shape:
                kind = T.ArrayType(kind)
        fields.append(T.StructField(name, kind, True, {"shape": list(shape), "fps": fps}))
    return T.StructType(fields)


def scan_frames(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every parquet file below ``<root>/data``, at any depth."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(f"{root}/data")


def coerce_feature(df: DataFrame, name: str, type_name: str, shape: tuple[int, ...]) -> Column:
    """A scalar-or-list column in its declared shape; shape (1,) becomes a scalar.

    Nested lists are flattened and must have the declared number of elements.
    """
    from framelens.functions.tensors import reshape

    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if not isinstance(kind, T.ArrayType):
        if tuple(shape) != (1,):
            raise ValueError(f"{name} is a scalar column but has the declared shape {shape}")
        return column.cast(type_name)
    while isinstance(kind.elementType, T.ArrayType):
        column, kind = F.flatten(column), kind.elementType
    if tuple(shape) == (1,):
        return F.element_at(column, 1).cast(type_name)
    return reshape(column.cast(f"array<{type_name}>"), tuple(shape))


def valid_flag(df: DataFrame, name: str) -> Column:
    """The valid flag as boolean; of a list the first element counts."""
    return coerce_feature(df, name, "bigint", (1,)) != 0


# ---- writing -------------------------------------------------------------------------------


def write_mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_description(spark: SparkSession, root: str, row: DataFrame, force: bool = False) -> None:
    """The description as one JSON file; ``row`` is a single row of the description columns."""
    path = f"{root}/meta/info.json"
    if not force and _exists(spark, path):
        raise FileExistsError(f"{path} exists already")
    line = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v")).first()["v"]
    write_text(spark, path, json.dumps(json.loads(line), indent=1, sort_keys=True) + "\n")


def write_labeled(
    source: DataFrame, labels: DataFrame, names: dict[str, Column], prefix: str, root: str, force: bool = False
) -> None:
    """Copy the source with ``<prefix>.<name>`` label columns and ``<prefix>.valid``.

    Existing output is an error unless forced. The only shuffle is the join on ``idx``.
    """
    from framelens.operators.labels import scatter_labels

    check_prefix(prefix)
    full = scatter_labels(source.drop("valid"), labels, names, valid="_valid")
    renamed = full.withColumnsRenamed({**{n: f"{prefix}.{n}" for n in names}, "_valid": f"{prefix}.valid"})
    renamed.write.mode(write_mode(force)).parquet(f"{root}/data")


def check_prefix(prefix: str) -> None:
    if prefix.startswith(fixed.FORBIDDEN_LABEL_PREFIX):
        raise ValueError(f"labels must not be stored below {fixed.FORBIDDEN_LABEL_PREFIX}")


def write_analysis(
    frames: DataFrame, label_columns: list[str], root: str, dataset: str, features: dict[str, tuple[str, tuple[int, ...], float]],
    fps: float, force: bool = False, chunks_size: int = 1000,
) -> None:
    """A small root with passthrough and label columns in index order, and its description."""
    from framelens.operators.frames import dataset_totals

    kept = [c for c in fixed.PASSTHROUGH_COLUMNS if c in frames.columns] + label_columns
    slim = frames.select(*[F.col(f"`{c}`") for c in kept])
    slim.repartitionByRange("index").sortWithinPartitions("index").write.mode(write_mode(force)).parquet(f"{root}/data")
    spark = frames.sparkSession
    described = F.map_from_entries(F.array(*[
        F.struct(
            F.lit(name),
            F.struct(
                F.lit(dtype).alias("dtype"),
                F.array(*[F.lit(d).cast("bigint") for d in shape]).alias("shape"),
                F.lit(None).cast("array<string>").alias("names"),
                F.lit(float(feature_fps)).alias("fps"),
            ),
        )
        for name, (dtype, shape, feature_fps) in features.items()
    ]))
    totals = dataset_totals(scan_frames(spark, root))
    write_description(spark, root, totals.select(
        F.lit(dataset).alias("dataset"),
        F.lit(float(fps)).alias("fps"),
        "total_episodes",
        "total_frames",
        "total_tasks",
        F.lit(chunks_size).cast("bigint").alias("chunks_size"),
        F.create_map(F.lit("train"), F.concat(F.lit("0:"), F.col("total_episodes").cast("string"))).alias("splits"),
        F.lit(True).alias("analysis_only"),
        described.alias("features"),
    ), force)


def write_result_table(table: DataFrame, path: str, per_sample: bool = False, force: bool = False) -> None:
    """CSV with a header; tables with one row per sample are compressed."""
    writer = table.write.mode(write_mode(force)).option("header", True)
    (writer.option("compression", "gzip") if per_sample else writer).csv(path)


def write_scores(scores: DataFrame, path: str, force: bool = False) -> None:
    """Long scores, one folder per format, so a reader of one format skips the others."""
    scores.write.mode(write_mode(force)).partitionBy("latent_format").parquet(path)


def write_stats(stats: DataFrame, path: str, force: bool = True) -> None:
    stats.write.mode(write_mode(force)).parquet(path)


# ---- manifests -----------------------------------------------------------------------------


def export_manifest_rows(labeled: DataFrame, catalog: DataFrame, constants: dict[str, Column]) -> DataFrame:
    """One manifest row per dataset: counts of the labeled rows and names from the catalog.

    ``labeled``: dataset, valid. ``catalog``: dataset, feature, dtype (label features only).
    """
    counts = labeled.groupBy("dataset").agg(
        F.count("*").alias("num_rows"), F.sum((F.col("valid") == 1).cast("bigint")).alias("num_valid_labels")
    )
    is_valid = F.col("feature").endswith(".valid")
    names = catalog.groupBy("dataset").agg(
        F.array_sort(F.collect_set(F.when(~is_valid, F.col("feature")))).alias("feature_names"),
        F.min(F.when(is_valid, F.col("feature"))).alias("valid_feature_name"),
        F.array_sort(
            F.collect_set(F.when(~is_valid & F.col("dtype").isin(*fixed.FLOATING_DTYPES), F.col("feature")))
        ).alias("stats_feature_names"),
    )
    return counts.join(names, "dataset").withColumns(constants)


def with_registration(manifests: DataFrame, manifest_path: Column, registry: Column, now: Column) -> DataFrame:
    """Schema version and creation time (kept when present), manifest path and registry path."""
    defaults = {"artifact_schema_version": F.lit(fixed.ARTIFACT_SCHEMA_VERSION).cast("bigint"), "created_at": now}
    for name, value in defaults.items():
        kept = F.coalesce(F.col(name), value) if name in manifests.columns else value
        manifests = manifests.withColumn(name, kept)
    return manifests.withColumn("manifest_path", manifest_path).withColumn("registry_path", registry)


def sorted_json(df: DataFrame, omit: tuple[str, ...] = ()) -> Column:
    """All columns as one JSON text with sorted keys."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in omit]))


def register(manifests: DataFrame, registry: str) -> None:
    """Append manifest rows to the registry as new JSON part files; no lock is needed."""
    manifests.select(sorted_json(manifests).alias("value")).write.mode("append").text(registry)


def parse_manifests(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("m")).select("m.*")


def parent_manifests(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """Per root the export manifest, else the label manifest; its own path by default."""
    from pyspark.sql import Window

    parts = None
    for priority, name in enumerate(fixed.MANIFEST_PRIORITY):
        paths = [f"{r}/{name}" for r in roots if _exists(spark, f"{r}/{name}")]
        if not paths:
            continue
        found = spark.read.option("multiLine", True).schema(schema).json(paths)
        found = found.select(
            "*", _root_of(F.col("_metadata.file_path"), name).alias("root"),
            F.lit(priority).alias("_priority"), F.lit(name).alias("_name"),
        )
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], f"{schema}, root string")
    order = Window.partitionBy("root").orderBy("_priority")
    both = parts.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    path = F.concat_ws("/", "root", "_name")
    kept = F.coalesce(F.col("manifest_path"), path) if "manifest_path" in both.columns else path
    return both.withColumn("manifest_path", kept).drop("_priority", "_name", "_rank")


def _filesystem(spark: SparkSession, path: str):
    """The path and its file system, through Spark's own access to the store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small text file; with ``overwrite`` off, creating a file that exists fails."""
    p, fs = _filesystem(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _filesystem(spark, path)
    return fs.exists(p)
