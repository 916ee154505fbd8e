"""What the text operators share: words, row keys, joins that survive hot keys, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framelens.session import shared_folder

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 32 << 20
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table, and only those: other columns cannot clash with results."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """Runs without white space (x20, x09-x0D); no words for null, empty or blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use yet, whatever it already has."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The table, written to the shared folder and read back: cuts the lineage for good."""
    return stored_counted(df, **options)[0]


def stored_counted(df: DataFrame, **options: str) -> tuple[DataFrame, int]:
    """As ``stored``, and the number of rows, counted while writing. Row groups are small: a task holds one."""
    spark = df.sparkSession
    path, seen = shared_folder(spark), Observation()
    settings = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)} | options
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**settings).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join every row to the one row of ``values`` with its key, with both sides shuffled.

    ``values`` has unique keys that are not null, and only the columns that are wanted. The key
    of the rows may be hot: adaptive execution splits its partition, as each key meets one row.
    Callers store the result before they group by the same key, or Spark would not split it.
    """
    return rows.join(values, keys, how)


def row_bytes(df: DataFrame) -> int:
    """An upper estimate of the bytes of a row of numbers and short keys."""
    return 16 + sum(24 if t in ("bigint", "int", "boolean", "double") else 64 for _, t in df.dtypes)


def join_checked(rows: DataFrame, values: DataFrame, keys: list[str], how: str, n_values: int | None = None) -> DataFrame:
    """Join with a stored table of unique keys: broadcast while its counted rows are small.

    Beyond the bound both sides are shuffled; Spark's handling of skewed joins splits the
    rows of a hot key. Null keys are equal.
    """
    small = (values.count() if n_values is None else n_values) * row_bytes(values) <= BROADCAST_BYTES
    other = values.select(*[F.col(c).alias(f"_v_{c}") if c in keys else F.col(c) for c in values.columns])
    on = _all(F.col(k).eqNullSafe(F.col(f"_v_{k}")) for k in keys)
    out = rows.join(F.broadcast(other) if small else other, on, how)
    return out.drop(*[f"_v_{k}" for k in keys])
