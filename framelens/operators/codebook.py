"""Nearest codes, shuffled controls and relaxed quantization of token vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import hashing, tensors
from framelens.operators.ordering import lookup_counted
from framelens.session import written

CODE_NUMBERS = 4_000_000
BLOCK_CODES = 4096
BLOCK_NUMBERS = 1 << 22
GROUP_TOKENS = 1 << 16


def nearest_code(
    tokens: DataFrame, codebook: DataFrame, key: list[str], vector: str = "vector",
    max_numbers: int = CODE_NUMBERS, block: int = BLOCK_CODES,
) -> DataFrame:
    """Adds ``code_id``, ``sq_distance`` of the nearest code; the lowest id wins a tie.

    A codebook of up to ``max_numbers`` numbers (counted first) goes to every task as one
    matrix. A larger one is cut into cells around pivots, and the triangle inequality decides
    which cells a token has to meet (``CodeCells``).
    """
    size = codebook.agg(F.count("*"), F.coalesce(F.max(F.size("code")), F.lit(0))).first()
    if size[0] * size[1] <= max_numbers:
        rows = codebook.orderBy("code_id").collect()  # at most max_numbers numbers
        ids = np.array([r["code_id"] for r in rows], dtype=np.int64)
        codes = np.array([r["code"] for r in rows], dtype=np.float64).reshape(size[0], size[1])
        return _search(tokens, vector, ids, codes)
    cells = CodeCells(codebook, size[0], size[1], max_numbers, block)
    hits = cells.nearest(tokens.select(*key, F.col(vector).cast("array<double>").alias("_x")), key)
    return tokens.join(hits, key)


class CodeCells:
    """A large codebook in cells around pivots, stored in blocks of at most ``block`` codes.

    Pivots are codes drawn by hash, few enough to go to every task. Every code belongs to its
    nearest pivot; a cell knows the smallest and largest distance of its codes to the pivot. A token
    first meets the cell of its nearest pivot, which gives a distance ``b`` to some code. Any code
    of a cell is at least ``max(d - largest, smallest - d)`` away, where d is the token's distance
    to the pivot, so only cells where that is at most ``b`` can hold a nearer or equal code; the
    rest is never compared, and the result is that of the plain search.
    """

    def __init__(self, codebook: DataFrame, n: int, size: int, max_numbers: int, block: int):
        spark = codebook.sparkSession
        most = max(1, min(int(np.sqrt(n)), max_numbers // max(size, 1)))
        drawn = codebook.orderBy(F.xxhash64("code_id"), "code_id").limit(most).collect()
        self.pivots = np.array([r["code"] for r in drawn], dtype=np.float64).reshape(len(drawn), size)
        own = _with_pivots(codebook.select("code_id", F.col("code").cast("array<double>").alias("_x")), self.pivots)
        own = written(spark, own)
        cell = own.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_far").alias("low"), F.max("_far").alias("high"))
        found = {r["_cell"]: r for r in cell.collect()}  # one row per pivot
        self.sizes = np.array([found[i]["n"] if i in found else 0 for i in range(len(drawn))])
        self.low = np.array([found[i]["low"] if i in found else np.inf for i in range(len(drawn))])
        self.high = np.array([found[i]["high"] if i in found else -np.inf for i in range(len(drawn))])
        # Codes of a cell ascend by their distance to the pivot, so a block is a shell of its cell.
        self.parts = np.maximum(1, -(-self.sizes // block))
        placed = own.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("_cell").orderBy("_far", "code_id")) - 1) / block).cast("int")) if (
            self.parts > 1).any() else own.withColumn("_part", F.lit(0))

        def packed(table: pa.Table) -> pa.Table:
            table = table.sort_by("code_id")
            flat = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.table({"_cell": table["_cell"].slice(0, 1), "_part": table["_part"].slice(0, 1), "_low": [min(table["_far"].to_pylist())], "_high": [max(table["_far"].to_pylist())],
                             "_ids": [table["code_id"].to_numpy().astype("<i8").tobytes()], "_codes": [np.ascontiguousarray(flat, "<f8").tobytes()]})

        self.blocks = written(spark, placed.groupBy("_cell", "_part").applyInArrow(
            packed, "_cell int, _part int, _low double, _high double, _ids binary, _codes binary"))
        shells = self.blocks.select("_cell", "_part", "_low", "_high").collect()  # about n / block + pivots rows
        shells.sort(key=lambda r: (r["_cell"], r["_part"]))
        self.shell_cell = np.array([r["_cell"] for r in shells], dtype=np.int64)
        self.shell_part = np.array([r["_part"] for r in shells], dtype=np.int32)
        self.shell_low = np.array([r["_low"] for r in shells])
        self.shell_high = np.array([r["_high"] for r in shells])

    def nearest(self, tokens: DataFrame, key: list[str]) -> DataFrame:
        """``key``, ``code_id`` and ``sq_distance`` of tokens with a vector ``_x``."""
        spark = tokens.sparkSession
        first = written(spark, self._met(written(spark, self._wanted(tokens, key, None)), key))
        bounded = tokens.join(first.withColumnRenamed("sq_distance", "_bound").drop("code_id"), key)
        rest = self._met(written(spark, self._wanted(bounded, key, "_bound")), key)
        best = F.min(F.struct("sq_distance", "code_id"))
        hits = first.unionByName(rest).groupBy(*key).agg(best.alias("_b"))
        return hits.select(*key, F.col("_b.code_id").alias("code_id"), F.col("_b.sq_distance").alias("sq_distance"))

    def _wanted(self, tokens: DataFrame, key: list[str], bound: str | None) -> DataFrame:
        """A row per token and block to compare: the nearest shell without a bound, else all others that may hold a code as near."""
        pivots, cell, low, high, part = self.pivots, self.shell_cell, self.shell_low, self.shell_high, self.shell_part
        kept = [*key, "_x"]

        def rows(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(len(key)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for start in range(0, len(flat), 512):
                    x = flat[start : start + 512]
                    far = np.sqrt(_pivot_squares(x, pivots))
                    d = far[:, cell]
                    least = np.maximum(np.maximum(d - high, low - d), 0)
                    first = np.lexsort((np.broadcast_to(np.arange(len(cell)), d.shape), d, least), axis=1)[:, 0]
                    if bound is None:
                        token, shell = np.arange(len(x)), first
                    else:
                        limit = np.sqrt(batch.column(len(key) + 1).to_numpy()[start : start + 512])[:, None]
                        rounding = 1e-9 * (1 + d + limit)  # distances to pivots are rounded, a shell at the bound is compared
                        wanted = least <= limit + rounding
                        wanted[np.arange(len(x)), first] = False
                        token, shell = np.nonzero(wanted)
                    places = pa.array(token + start)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(places) for i in range(len(kept))), pa.array(cell[shell], pa.int32()), pa.array(part[shell], pa.int32())],
                                                     names=[*kept, "_cell", "_part"])

        own = tokens.select(*kept, *([] if bound is None else [bound]))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != bound)
        return own.mapInArrow(rows, f"{fields}, _cell int, _part int")

    def _met(self, wanted: DataFrame, key: list[str]) -> DataFrame:
        """The best code of each token among the blocks that it meets.

        Tokens of a block are dealt to as many groups as their counted number needs, each of
        which gets a copy of the block.
        """
        names = [*key, "sq_distance", "code_id"]
        counts = wanted.groupBy("_cell", "_part").agg(F.ceil(F.count("*") / GROUP_TOKENS).cast("int").alias("_groups"))
        counts = written(wanted.sparkSession, counts)  # one row per block
        dealt = wanted.join(F.broadcast(counts), ["_cell", "_part"]).withColumn("_group", F.pmod(F.xxhash64(*key), F.col("_groups")).cast("int")).drop("_groups")
        copies = self.blocks.select("_cell", "_part", "_ids", "_codes").join(F.broadcast(counts), ["_cell", "_part"])
        copies = copies.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

        def best_of(tokens: pa.Table, blocks: pa.Table) -> pa.Table:
            own = np.frombuffer(blocks["_ids"][0].as_py(), "<i8")
            codes = np.frombuffer(blocks["_codes"][0].as_py(), "<f8").reshape(len(own), -1)
            x = tokens["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(tokens.num_rows, -1)
            step = max(1, BLOCK_NUMBERS // max(len(own), 1))
            parts = [nearest(x[i : i + step], own, codes) for i in range(0, len(x), step)]
            hit, squared = (np.concatenate(p) if parts else np.empty(0) for p in zip(*parts))
            return pa.table([*(tokens[c] for c in key), pa.array(squared, pa.float64()), pa.array(hit, pa.int64())], names=names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in key)
        on = ["_cell", "_part", "_group"]
        found = dealt.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(best_of, f"{fields}, sq_distance double, code_id bigint")
        best = found.groupBy(*key).agg(F.min(F.struct("sq_distance", "code_id")).alias("_b"))
        return best.select(*key, F.col("_b.code_id").alias("code_id"), F.col("_b.sq_distance").alias("sq_distance"))


def _pivot_squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances to all pivots; far offsets are taken off first."""
    mid = pivots.mean(0)
    y, p = x - mid, pivots - mid
    return np.maximum((y * y).sum(1)[:, None] - 2 * (y @ p.T) + (p * p).sum(1)[None, :], 0)


def _with_pivots(codes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``_cell`` (nearest pivot) and ``_far`` (distance to it) of every code."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = _pivot_squares(x, pivots).argmin(1)
            far = np.sqrt(_differences(x, pivots[cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["code_id", "_x", "_cell", "_far"])

    return codes.mapInArrow(rows, f"code_id {dict(codes.dtypes)['code_id']}, _x array<double>, _cell int, _far double")


def nearest(x: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and squared distance of the nearest code of each row of ``x``; ids ascend, the lowest wins a tie."""
    centre = codes.mean(0) if len(codes) else 0.0  # far offsets would cancel in the expanded square
    near, y = codes - centre, x - centre
    norms = (near * near).sum(1)
    slack = 8 * np.finfo(float).eps * max(codes.shape[-1], 1)
    own = (y * y).sum(1)[:, None]
    squared = own - 2 * (y @ near.T) + norms[None, :]
    hit = squared.argmin(1)
    # Candidates within the rounding error are decided by exact differences, as in blocks.
    close = squared <= squared.min(1)[:, None] + slack * (own + norms[None, :])
    for i in np.flatnonzero(close.sum(1) > 1):
        few = np.flatnonzero(close[i])
        hit[i] = few[_differences(x[i], codes[few]).argmin()]
    return ids[hit], _differences(x, codes[hit])


def _search(tokens: DataFrame, vector: str, ids: np.ndarray, codes: np.ndarray) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            hit, squared = nearest(np.stack(pdf[vector].to_numpy()).astype(np.float64), ids, codes)
            yield pdf.assign(code_id=hit, sq_distance=squared)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInPandas(find, f"{fields}, code_id bigint, sq_distance double")


def _differences(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the dimensions."""
    d = (x - codes) ** 2
    return d.cumsum(1)[:, -1] if d.shape[1] else np.zeros(len(d))


def with_code_vectors(
    rows: DataFrame, codebook: DataFrame, key: str = "idx", max_numbers: int = CODE_NUMBERS, name: str = "code_id"
) -> DataFrame:
    """Attach the vector of the row's code: a small codebook is broadcast after counting it,
    else the rows of much used codes are salted. ``name`` is the column of the ids on both sides."""
    vector = next(c for c in codebook.columns if c != name)
    size = codebook.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    if size[0] * size[1] <= max_numbers:
        return rows.join(F.broadcast(codebook), name)
    used = rows.groupBy(name).agg(F.count("*").alias("_used"))
    return lookup_counted(rows, codebook.join(used, name), name, "_used", key).drop("_used")


def relaxed(rows: DataFrame, delta: str, code: str, key: str, seed: int, size: int, eps: float = 0.0) -> DataFrame:
    """``relaxed`` = delta + (|delta - code| / |random| + eps) * random, reproducible by key."""
    residual = tensors.l2_norm(tensors.difference(F.col(delta), F.col(code)))

    def moved(random: Column) -> Column:
        scale = residual / tensors.l2_norm(random) + F.lit(float(eps))
        return tensors.bound(scale, lambda s: F.zip_with(delta, random, lambda d, r: d + s * r))

    return rows.withColumn("relaxed", tensors.bound(hashing.noise_array(F.col(key), size, seed), moved))


def shuffled_control(rows: DataFrame, key: str, value: str, batch_rows: int, seed: int) -> DataFrame:
    """``shuffled``: the value of another row, by a random permutation inside each batch.

    A batch is a range of ``batch_rows`` keys, so its windows are bounded; a batch of one row
    keeps its own value.
    """
    tagged = rows.where(F.col(key).isNotNull()).withColumn("_batch", F.floor(F.col(key) / batch_rows).cast("bigint"))
    by_key = Window.partitionBy("_batch").orderBy(key)
    by_random = Window.partitionBy("_batch").orderBy("_random", key)
    ranked = tagged.withColumn("_random", hashing.random_key(F.col(key), seed)).withColumn(
        "_place", F.row_number().over(by_key)
    ).withColumn("_drawn", F.row_number().over(by_random))
    # A row goes to its own place and gives its value to the place it drew. Places are a finer
    # key than batches, so the last window finds the rows of a batch where the others left them.
    taker = F.struct(F.col("_place").alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).alias("_given"))
    giver = F.struct(F.col("_drawn").alias("_at"), F.lit(None).alias("_row"), F.struct(F.col(value).alias("v")).alias("_given"))
    both = ranked.select("_batch", F.explode(F.array(taker, giver)).alias("_s")).select("_batch", "_s.*")
    met = both.withColumn("_given", F.first("_given", ignorenulls=True).over(Window.partitionBy("_batch", "_at")))
    return met.where(F.col("_row").isNotNull()).select("_row.*", F.col("_given.v").alias("shuffled"))
