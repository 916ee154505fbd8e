"""Order-dependent building blocks that never put one whole episode or table in one task.

An episode, a bucket or a label sequence may hold a third of all rows, so a window that is
partitioned by it alone would run in one task. Here windows are partitioned by
``(group, slice)``; the sums of the slices (a small table) carry the running state across.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.hashing import key_slice, random_key

CHUNK_FRAMES = 65536
COARSE_EPISODES = 4096
HOT_SHARE = 1000
SALTS = 64
EPISODE_SALTS = 16
BROADCAST_ROWS = 100_000


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a table with one row per key, where the caller bounds the keys.

    Keys are names of bucketings, formats, slots or dimensions, so the table is tiny. Without
    keys the table is a single row and becomes a scalar.
    """
    if keys:
        return df.join(F.broadcast(table), list(keys))
    row = table.select(F.struct(*table.columns).alias("row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def chunk_of(frame: str = "frame_index", chunk: int = CHUNK_FRAMES) -> Column:
    return F.floor(F.col(frame) / F.lit(chunk)).cast("bigint")


def slice_totals(df: DataFrame, group: Sequence[str], slices: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Per (group, slice): each measure, its sum over earlier slices and over the group.

    Partial aggregation reduces the rows before the shuffle; the window then sees one row per slice.
    """
    totals = df.groupBy(*group, *slices).agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    ordered = Window.partitionBy(*group).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group).orderBy(*slices).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return totals.select(
        *group,
        *slices,
        *measures,
        *[F.coalesce(F.sum(n).over(ordered), F.lit(0)).alias(f"{n}_before") for n in measures],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in measures],
    )


def positions(
    df: DataFrame,
    group: Sequence[str],
    slice_value: Column,
    order: Sequence[str | Column],
    position: str,
    length: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group and, if asked, the size of the group.

    ``slice_value`` must not decrease along ``order``.
    """
    sliced = df.withColumn("_slice", slice_value)
    totals = slice_totals(sliced, group, ["_slice"], {"_rows": F.lit(1)})
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_in_slice", F.row_number().over(inside))
    joined = ranked.join(totals.drop("_rows"), [*group, "_slice"])
    out = joined.withColumn(position, F.col("_rows_before") + F.col("_in_slice") - 1)
    if length:
        out = out.withColumn(length, F.col("_rows_total"))
    return out.drop("_slice", "_in_slice", "_rows_before", "_rows_total")


def running_before(
    table: DataFrame,
    order: Sequence[str],
    coarse: Column,
    measures: dict[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Sum of each measure over all earlier rows of a table in one global order.

    ``coarse`` cuts the order into slices and must not decrease along it. Only the slice
    sums meet in one task.
    """
    sliced = table.withColumn("_coarse", coarse)
    named = {f"_m{i}": m for i, m in enumerate(measures.values())}
    sums = slice_totals(sliced, [], ["_coarse"], named)
    sums = sums.drop(*named)
    inside = Window.partitionBy("_coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(sums, "_coarse")
    for i, (name, measure) in enumerate(measures.items()):
        out = out.withColumn(
            f"{name}_before", F.col(f"_m{i}_before") + F.coalesce(F.sum(measure).over(inside), F.lit(0))
        )
        if totals:
            out = out.withColumn(f"{name}_total", F.col(f"_m{i}_total"))
    return out.drop("_coarse", *[f"{n}_{s}" for n in named for s in ("before", "total")])


def with_halo(df: DataFrame, before: int = 0, after: int = 0, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Add ``_chunk`` and ``_own``; edge frames are also copied into the neighbouring chunk.

    A window over (episode_index, _chunk) then sees ``before`` earlier and ``after`` later
    frames of every own row. Rows with ``_own = false`` are to be dropped afterwards.
    """
    if before > chunk or after > chunk:
        raise ValueError("the chunk must be at least as long as the window")
    chunk_id = chunk_of(chunk=chunk)
    offset = F.col("frame_index") - chunk_id * chunk
    copies = [chunk_id]
    if after:
        copies.append(F.when((offset < after) & (chunk_id > 0), chunk_id - 1))
    if before:
        copies.append(F.when(offset >= chunk - before, chunk_id + 1))
    return df.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies)))).withColumn(
        "_own", F.col("_chunk") == chunk_id
    )


def episode_window() -> Window:
    return Window.partitionBy("episode_index", "_chunk").orderBy("frame_index")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def at_offset(feature: Column, n: int) -> Column:
    """Value of the frame exactly ``n`` frames later (earlier if negative), else null."""
    w = episode_window()
    if n == 0:
        return feature
    shift = (lambda c: F.lead(c, n).over(w)) if n > 0 else (lambda c: F.lag(c, -n).over(w))
    return F.when(shift(F.col("frame_index")) == F.col("frame_index") + n, shift(feature))


def random_ranks(
    df: DataFrame,
    key: str,
    seed: int | str,
    rank: str = "rank",
    total: str = "n_rows",
    limit: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """1-based rank of every row in a random order that depends on the key and seed only.

    With ``limit`` (a function of the row count) only the first rows are kept; slices that
    lie wholly behind the limit are dropped before anything is shuffled. The slice sums have
    at most 65536 rows, so that broadcast is bounded.
    """
    tagged = df.withColumn("_random", random_key(F.col(key), seed)).withColumn("_slice", key_slice(F.col("_random")))
    sums = slice_totals(tagged, [], ["_slice"], {"_rows": F.lit(1)}).drop("_rows")
    if limit is not None:
        sums = sums.where(F.col("_rows_before") < limit(F.col("_rows_total")))
    inside = Window.partitionBy("_slice").orderBy("_random", key)
    out = (
        tagged.join(F.broadcast(sums), "_slice")
        .withColumn(rank, F.col("_rows_before") + F.row_number().over(inside))
        .withColumn(total, F.col("_rows_total"))
    )
    if limit is not None:
        out = out.where(F.col(rank) <= limit(F.col(total)))
    return out.drop("_random", "_slice", "_rows_before", "_rows_total")


def lookup_counted(df: DataFrame, table: DataFrame, key: str, weight: str, row_key: str) -> DataFrame:
    """Join each row to the one table row of its key, where ``weight`` counts the rows of a key.

    Keys that hold more than 1/1000 of all rows (so fewer than 1000 keys) are salted: their
    rows spread over 64 copies of the table row. All other keys join as they are.
    """
    everything = table.agg(F.sum(weight)).scalar()
    hot = table.where(F.col(weight) * HOT_SHARE > everything).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    rows = df.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    spread = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return rows.join(spread, [key, "_salt"]).drop("_salt")


def join_by_episode(rows: DataFrame, episodes: DataFrame, how: str, spread_by: str = "frame_index") -> DataFrame:
    """Join rows with a table of one row per episode, without one task per long episode.

    The rows of an episode that holds more than 1/1000 of all (so fewer than 1000 episodes)
    spread over 16 salts, and its row is copied to each of them. All others join as they are.
    """
    column = spread_by if spread_by in rows.columns else "idx"
    counts = rows.groupBy("episode_index").agg(F.count("*").alias("_n"))
    long = _over_share(counts, "episode_index", "_n")
    salt = F.when(F.col("episode_index").isin(long), F.pmod(F.col(column), F.lit(EPISODE_SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("episode_index").isin(long), F.sequence(F.lit(0), F.lit(EPISODE_SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = episodes.withColumn("_salt", F.explode(salts))
    return rows.withColumn("_salt", salt).join(copies, ["episode_index", "_salt"], how).drop("_salt")


def _over_share(counts: DataFrame, key: str, weight: str) -> list:
    """Keys of more than 1/1000 of the total weight: fewer than 1000."""
    found = counts.where(F.col(key).isNotNull())
    total = found.agg(F.sum(weight)).first()[0] or 0
    return [r[0] for r in found.where(F.col(weight) * HOT_SHARE > F.lit(total)).select(key).collect()]


def sized(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose rows were counted, if they are few; else let Spark shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
