"""Derived tables that are written once per session and read by every later job.

Analyses read the same labeled frames many times, so the frames are ordered and joined with
their labels once, as a stored dataset. The table goes to the shared folder of the cluster;
reading it back is an exact cut of the lineage that survives the loss of any executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelens.session import shared_folder, shuffles_dropped

_WRITTEN: dict[tuple, tuple[str, object]] = {}


def _stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Size and modification time of the inputs, so a changed input is prepared anew."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        status = path.getFileSystem(conf).getFileStatus(path)
        stamps.append((status.getLen(), status.getModificationTime()))
    return tuple(stamps)


def prepared(
    spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]
) -> DataFrame:
    key = (spark.sparkContext.applicationId, name, tuple(inputs), _stamp(spark, inputs))
    if key not in _WRITTEN:
        df = build()
        path = shared_folder(spark)
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = (path, df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
