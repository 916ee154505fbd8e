"""A registry of artifacts with one valid record per id, whoever registers at the same time.

A registration stages its records as JSON lines in a folder of its own and then claims the next
numbered commit file, which names that folder. Claiming is atomic: the file appears complete or
not at all, and only one of several claimants of a number gets it. Whoever loses reads the
commits that came in between, checks its ids against their records (a join, on the executors) and
claims again. Records without a commit, of a job that died, are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.sources.datasets import _exists, _filesystem, sorted_json, write_text

COMMITS = "_commits"


class RegistryConflict(ValueError):
    """An id is registered already."""


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Create a complete file unless it is there; false if somebody else was first."""
    p, fs = _filesystem(spark, path)
    jvm = spark.sparkContext._jvm
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    write_text(spark, draft, text)
    d, _ = _filesystem(spark, draft)
    try:
        if fs.getScheme() == "file":  # a local rename would replace the file; a link never does
            files, local = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
            none = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            files.createLink(local.get(p.toUri().getPath(), none), local.get(d.toUri().getPath(), none))
            return True
        return bool(fs.rename(d, p)) if not fs.exists(p) else False  # a rename onto a file fails
    except Exception as refused:
        if "FileAlreadyExists" in str(refused):
            return False
        raise
    finally:
        fs.delete(d, False)


def _commits(spark: SparkSession, registry: str) -> list[tuple[int, str]]:
    """Number and folder of every commit, in order."""
    base = f"{registry}/{COMMITS}"
    if not _exists(spark, base):
        return []
    found = spark.read.option("pathGlobFilter", "*.json").schema("folder string").json(base)
    named = found.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("n"), "folder")
    return sorted((r.n, r.folder) for r in named.collect())  # one row per registration


def _records(spark: SparkSession, registry: str, folders: list[str]) -> DataFrame:
    paths = [f"{registry}/{name}" for name in folders]
    return spark.read.text(paths) if paths else spark.createDataFrame([], "value string")


def records(spark: SparkSession, registry: str) -> DataFrame:
    """JSON lines (``value``) of all committed records."""
    return _records(spark, registry, [folder for _, folder in _commits(spark, registry)])


def register(manifests: DataFrame, registry: str, key: str = "artifact_id") -> int:
    """Add manifest rows; the number of the commit. An id that is there, or twice among the rows, is a conflict."""
    spark = manifests.sparkSession
    folder = f"records-{uuid.uuid4().hex}"
    manifests.select(sorted_json(manifests).alias("value")).write.text(f"{registry}/{folder}")
    own = _records(spark, registry, [folder]).select(F.get_json_object("value", f"$['{key}']").alias("id"))
    twice = own.groupBy("id").count().where("count > 1").limit(3).collect()
    if twice:
        raise RegistryConflict(f"{key} given twice: {', '.join(str(r.id) for r in twice)}")
    base, fs = _filesystem(spark, f"{registry}/{COMMITS}")
    fs.mkdirs(base)
    checked = 0
    while True:
        commits = _commits(spark, registry)
        new = [name for n, name in commits if n > checked]
        if new:
            there = _records(spark, registry, new).select(F.get_json_object("value", f"$['{key}']").alias("id"))
            clash = own.where("id is not null").join(there, "id", "left_semi").limit(3).collect()
            if clash:
                raise RegistryConflict(f"{key} registered already: {', '.join(str(r.id) for r in clash)}")
            checked = commits[-1][0]
        if _claimed(spark, f"{registry}/{COMMITS}/{checked + 1:020d}.json", json.dumps({"folder": folder})):
            return checked + 1
