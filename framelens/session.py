"""Session settings used by tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 2 << 30  # that one part of a table may shuffle, about
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framelens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one job below the shared folder that the cluster names.

    Only a local session, where driver and executors are one process, may fall back to a
    folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster, which has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="framelens-")
    return os.path.join(base, f"framelens-{uuid.uuid4().hex}")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A write inside removes its shuffle files when it ends; else they lie there until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(spark: SparkSession, df, folder: str | None = None):
    """Write a table to the shared folder and read it back: an exact cut of the lineage."""
    path = folder or shared_folder(spark)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(rows: int, numbers: int) -> int:
    """How many parts ``rows`` rows of so many eight-byte numbers are shuffled in."""
    return max(1, -(-rows * 8 * numbers // PART_BYTES))


def written_in_parts(spark: SparkSession, part: Callable[[int], DataFrame], parts: int, by: str | None = None) -> DataFrame:
    """As ``written``, part after part, so that shuffle files never hold more than one part of the table."""
    path = shared_folder(spark)
    with shuffles_dropped(spark):
        for p in range(parts):
            df = part(p)
            out = df.write.mode("append").option("compression", "zstd")
            (out.partitionBy(by) if by else out).parquet(path)
    if by:
        df = df.select(*[c for c in df.columns if c != by], by)
    return spark.read.schema(df.schema).parquet(path)


def in_part(key, part: int, parts: int):
    """Whether a row is in a part, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)) == part
