"""Scans of dataset roots that open only files which can hold the wanted episodes.

``index_files`` reads the footer of every data file on the executors and stores one row per file
(path, rows, smallest and largest episode) beside the dataset. ``scan_episodes`` compares the
wanted episodes with those ranges before Spark plans the scan, so other files are not opened.
A file whose footer has no range is always read, and an index that no longer fits the listed files
(another path, size or modification time) is made again.

``FrameSource`` is the same as a data source: ``spark.read.format("frames").load(root)`` takes its
schema from the dataset's description, with shape and fps in the field metadata, plans a partition
per file, and skips files and row groups by the filters that Spark pushes to it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from framelens.operators.ordering import sized
from framelens.sources.datasets import declared_schema

INDEX = "meta/file_index"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _range(metadata: pq.FileMetaData, column: str) -> tuple[int | None, int | None]:
    """Smallest and largest value by the footer; nothing when a row group does not say."""
    at = [i for i in range(metadata.num_columns) if metadata.schema.column(i).path == column]
    if not at:
        return None, None
    low, high = [], []
    for g in range(metadata.num_row_groups):
        stats = metadata.row_group(g).column(at[0]).statistics
        if metadata.row_group(g).num_rows == 0:
            continue
        if stats is None or not stats.has_min_max:
            return None, None
        low.append(stats.min)
        high.append(stats.max)
    return (min(low), max(high)) if low else (None, None)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``size`` and ``changed`` of every parquet file below ``<root>/data``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return reader.load(f"{root}/data").select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("changed"))


def index_files(spark: SparkSession, root: str, column: str = "episode_index") -> DataFrame:
    """Read all footers, store the index in the dataset, and return it."""

    def footers(batches):
        for batch in batches:
            rows, low, high = [], [], []
            for path in batch.column(0).to_pylist():
                fs, name = _opened(path)
                with fs.open_input_file(name) as f:
                    metadata = pq.ParquetFile(f).metadata
                lo, hi = _range(metadata, column)
                rows.append(metadata.num_rows)
                low.append(lo)
                high.append(hi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                             names=["path", "size", "changed", "rows", "low", "high"])

    found = listed_files(spark, root).mapInArrow(footers, "path string, size long, changed double, rows long, low long, high long")
    found.write.mode("overwrite").parquet(f"{root}/{INDEX}")
    return spark.read.parquet(f"{root}/{INDEX}")


def file_index(spark: SparkSession, root: str, column: str = "episode_index") -> DataFrame:
    """The stored index if it fits the files that are there, else a new one."""
    try:
        stored = spark.read.parquet(f"{root}/{INDEX}").select("path", "size", "changed", "rows", "low", "high")
        listed, names = listed_files(spark, root), ["path", "size", "changed"]
        if listed.exceptAll(stored.select(*names)).isEmpty() and stored.select(*names).exceptAll(listed).isEmpty():
            return stored
    except Exception as missing:  # no index yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    return index_files(spark, root, column)


def files_with(spark: SparkSession, root: str, episodes: DataFrame, column: str = "episode_index") -> list[str]:
    """Paths of the files whose range holds one of the episodes.

    Spark's own listing brings all paths to the driver, as does this; the episodes stay on the
    executors, each of which names the files that its episodes need.
    """
    ranges = sorted(file_index(spark, root, column).where("rows > 0").select("path", "low", "high").collect())
    low = np.array([-(2**63) if r.low is None else r.low for r in ranges], dtype=np.int64)
    high = np.array([2**63 - 1 if r.low is None else r.high for r in ranges], dtype=np.int64)

    def needed(batches):
        hit = np.zeros(len(low), bool)
        for batch in batches:
            own = np.unique(batch.column(0).drop_null().to_numpy())
            if len(own):
                first = np.searchsorted(own, low)
                hit |= (first < len(own)) & (own[np.minimum(first, len(own) - 1)] <= high)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit), pa.int64())], names=["file"])

    found = episodes.select(F.col(column).cast("long").alias("e")).mapInArrow(needed, "file long").distinct().collect()
    return [ranges[r.file].path for r in sorted(found)]


def scan_episodes(spark: SparkSession, root: str, episodes: DataFrame | None, schema: T.StructType | None = None, column: str = "episode_index") -> DataFrame:
    """Rows of the wanted episodes (all of them for none given), reading only files that can hold them."""
    from framelens.sources.datasets import scan_frames

    if episodes is None:
        return scan_frames(spark, root, schema)
    whole = schema or scan_frames(spark, root).schema
    paths = files_with(spark, root, episodes, column)
    if not paths:
        return spark.createDataFrame([], whole)
    wanted = episodes.select(column).where(F.col(column).isNotNull()).distinct()
    rows = spark.read.schema(whole).parquet(*paths)
    return rows.join(sized(wanted, wanted.count()), column, "left_semi").select(*[f"`{c}`" for c in whole.fieldNames()])


# ---- the same as a data source ---------------------------------------------------------------


class FrameFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameSource(DataSource):
    """Frames of a dataset root. Options: ``path`` (the root) and ``columns`` (a comma-separated choice)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> T.StructType:
        fs, name = _opened(f"{self.options['path']}/meta/info.json")
        with fs.open_input_stream(name) as f:
            described = json.loads(f.read())
        features = {n: (s["dtype"], tuple(s["shape"]), float(s.get("fps") or described.get("fps") or 0)) for n, s in described["features"].items()}
        chosen = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(features)
        unknown = [c for c in chosen if c not in features]
        if unknown:
            raise ValueError(f"the dataset declares no feature {', '.join(unknown)}")
        return declared_schema({c: features[c] for c in chosen})

    def reader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(self.options["path"], schema)


class FrameReader(DataSourceReader):
    COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, root: str, schema: T.StructType):
        self.root, self.schema, self.filters = root, schema, []

    def pushFilters(self, filters):
        """Comparisons of a whole column with values are applied here; Spark applies the others."""
        for f in filters:
            if isinstance(f, (*self.COMPARED, In)) and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], "in", list(f.value)) if isinstance(f, In) else (f.attribute[0], self.COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[FrameFile]:
        fs, base = _opened(f"{self.root}/data")
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet"))
        return [FrameFile(p) for p in paths if self._may_match(fs, p)]

    def _may_match(self, fs: pafs.FileSystem, path: str) -> bool:
        if not self.filters:
            return True
        with fs.open_input_file(path) as f:
            metadata = pq.ParquetFile(f).metadata
        for column, kind, value in self.filters:
            low, high = _range(metadata, column)
            values = value if kind == "in" else [value]
            if low is None or any(v is None for v in values):
                continue
            if kind in ("==", "in") and not any(low <= v <= high for v in values):
                return False
            if (kind == ">" and high <= value) or (kind == ">=" and high < value) or (kind == "<" and low >= value) or (kind == "<=" and low > value):
                return False
        return True

    def read(self, partition: FrameFile):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no file may match
            return
        fs, _ = _opened(f"{self.root}/data")
        wanted = None
        for column, kind, value in self.filters:
            own = pads.field(column)
            one = own.isin(value) if kind == "in" else {"==": own == value, ">": own > value, ">=": own >= value, "<": own < value, "<=": own <= value}[kind]
            wanted = one if wanted is None else wanted & one
        shape = to_arrow_schema(self.schema)
        names = [f.name for f in self.schema.fields]
        for batch in pads.dataset(partition.path, filesystem=fs, format="parquet").to_batches(columns=names, filter=wanted):
            if batch.num_rows:
                yield batch.cast(pa.schema([pa.field(f.name, f.type) for f in shape]))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("frames")`` known to the session, and let it push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
