"""Clusters by mini-batches: centres move with the batches, every row is assigned at the end.

Rows are packed once into blocks that a hash of the key deals to batches, so a fit does not
depend on how the table is cut. First centres come from a weighted draw in few passes: every
round takes the rows with the smallest of -ln(u) / d2, where u is a hash of the key and d2 the
squared distance to the candidates so far; each task keeps its own smallest ones, so the draw is
one ordered limit. The candidates, weighted by the rows nearest to them, are thinned out on the
driver. A step then assigns one batch, and each centre moves towards the mean of its rows by
their share among all rows it has seen. There are few batches, which grow with the table, and a fit
ends after a whole round over them at the earliest, so every row moves a centre. Each batch is stored
apart, so a step reads its own rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.operators.codebook import nearest
from framelens.session import shared_folder

BLOCK_ROWS = 4096
BATCH_ROWS = 16384
MOST_BATCHES = 32
ROUNDS = 100
DRAWS = 4
SUM_GROUPS = 16
FILE_BLOCKS = 64  # stored in one file, where no step reads them alone
BATCH_FILES = 64  # of one batch at most, about


@dataclass(frozen=True)
class Fit:
    """Steps at most (none given: ``ROUNDS`` rounds over all batches), steps without a smaller (smoothed)
    loss before the fit ends, and the seed."""

    steps: int | None = None
    patience: int = 6
    seed: int = 0


def blocks(rows: DataFrame, key: str, x: str, n: int, seed: int, batch_rows: int, steps: int) -> tuple[DataFrame, int]:
    """Stored matrices (``batch``, ``n``, ``h`` hashes of the keys, ``x``) and the number of batches.

    Each of the first ``steps`` batches is a folder of its own; all others, which only passes over
    the whole table read, share one (``batch`` -1).
    """
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    n_batches = max(1, min(n_blocks, n // batch_rows))
    together = max(1, n_blocks // (n_batches * BATCH_FILES))  # blocks in a file of a batch
    dealt = F.xxhash64(F.lit(seed), F.col(key))
    block = F.pmod(dealt, F.lit(n_blocks)).cast("int")
    own = F.pmod(block, F.lit(n_batches)).cast("int")
    keyed = rows.select(dealt.alias("h"), F.col(x).cast("array<double>").alias("x"), block.alias("block"), F.when(own < steps, own).otherwise(-1).alias("batch"))
    placed = keyed.withColumn("file", F.when(F.col("batch") < 0, F.floor(F.col("block") / FILE_BLOCKS)).otherwise(F.floor(F.col("block") / (n_batches * together))).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        flat = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"batch": pa.array([table["batch"][0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int32()),
                         "h": [table["h"].to_numpy().astype("<i8").tobytes()], "x": [np.ascontiguousarray(flat, "<f8").tobytes()]})

    done = placed.repartition("batch", "file").groupBy("batch", "file", "block").applyInArrow(packed, "batch int, n int, h binary, x binary")
    path = shared_folder(rows.sparkSession)
    done.write.partitionBy("batch").parquet(path)
    stored = rows.sparkSession.read.schema("n int, h binary, x binary, batch int").parquet(path)
    return stored.select("batch", "n", "h", "x"), n_batches


def _matrices(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            n, h, x = (batch.column(i)[at].as_py() for i in (1, 2, 3))
            yield np.frombuffer(h, "<i8"), np.frombuffer(x, "<f8").reshape(n, -1)


def _rdd(table: DataFrame) -> RDD:
    return table.select("n", "x").rdd.map(tuple)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    mid = centres.mean(0)
    y, c = x - mid, centres - mid
    return np.maximum((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)[None, :], 0)


def _units(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes, other ones for every salt."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _drawn(table: DataFrame, candidates: np.ndarray | None, m: int, salt: int) -> np.ndarray:
    """The ``m`` rows of smallest -ln(u) / d2; rows that are candidates already are never drawn."""

    def smallest(batches):
        scores, hashes, vectors = np.empty(0), np.empty(0, np.int64), None
        for h, x in _matrices(batches):
            weight = np.ones(len(x)) if candidates is None else _squared(x, candidates).min(1)
            with np.errstate(divide="ignore"):
                score = np.where(weight > 1e-12, -np.log(_units(h, salt)) / weight, np.inf)
            scores, hashes = np.append(scores, score), np.append(hashes, h)
            vectors = x if vectors is None else np.vstack([vectors, x])
            best = np.lexsort((hashes, scores))[:m]
            best = best[np.isfinite(scores[best])]
            scores, hashes, vectors = scores[best], hashes[best], vectors[best]
        yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(hashes), pa.array([] if vectors is None else vectors.tolist(), pa.list_(pa.float64()))], names=["score", "h", "x"])

    found = table.mapInArrow(smallest, "score double, h long, x array<double>").orderBy("score", "h", "x").limit(m).collect()
    return np.array([r.x for r in found])


def _sums(table: RDD, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the sum and number of its rows, and the sum of squared distances, over blocks (``n``, ``x``)."""
    k, d = centres.shape

    def summed(found):
        total, counts, loss = np.zeros((k, d)), np.zeros(k), 0.0
        for n, raw in found:
            x = np.frombuffer(raw, "<f8").reshape(n, -1)
            squared = _squared(x, centres)
            own = squared.argmin(1)
            loss += float(squared[np.arange(len(x)), own].sum())
            counts += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            total[own[order][starts]] += np.add.reduceat(x[order], starts)
        yield np.concatenate([total.ravel(), counts, [loss]])

    parts = table.mapPartitions(summed)
    if table.getNumPartitions() > SUM_GROUPS:
        parts = parts.mapPartitionsWithIndex(lambda i, own: ((i % SUM_GROUPS, one) for one in own)).reduceByKey(np.add, SUM_GROUPS).values()
    flat = np.sum([np.zeros(k * d + k + 1), *parts.collect()], 0)  # at most SUM_GROUPS rows, none of an empty batch
    return flat[: k * d].reshape(k, d), flat[k * d : k * d + k], float(flat[-1])


def _thinned(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the candidates, spread by weighted distance, then settled by a few weighted rounds."""
    rng = np.random.default_rng(seed)
    best, best_loss = None, np.inf
    for _ in range(3):
        chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
        nearest_yet = _squared(candidates, candidates[chosen])[:, 0]
        while len(chosen) < k:
            mass = weights * nearest_yet
            chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())) if mass.sum() > 0 else next(i for i in range(len(candidates)) if i not in chosen))
            nearest_yet = np.minimum(nearest_yet, _squared(candidates, candidates[chosen[-1:]])[:, 0])
        centres = candidates[chosen].copy()
        for _ in range(10):
            squared = _squared(candidates, centres)
            own = squared.argmin(1)
            mass = np.bincount(own, weights, k)
            moved = np.column_stack([np.bincount(own, weights * candidates[:, j], k) for j in range(candidates.shape[1])])
            centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        loss = float((weights * _squared(candidates, centres).min(1)).sum())
        if loss < best_loss:
            best, best_loss = centres, loss
    return best


def fit(rows: DataFrame, key: str, x: str, k: int, n: int, how: Fit = Fit()) -> np.ndarray:
    """Centres (at most ``k``: no more than there are different rows) of ``n`` rows with an array column ``x``."""
    table, n_batches = blocks(rows, key, x, n, how.seed, max(BATCH_ROWS, 64 * k, -(-n // MOST_BATCHES)), MOST_BATCHES)
    whole = table.persist(StorageLevel.MEMORY_AND_DISK)
    apart: dict[int, RDD] = {}
    try:
        candidates = _drawn(whole, None, 1, 0)
        if not len(candidates):
            return np.empty((0, 0))
        for salt in range(1, DRAWS + 1):
            more = _drawn(whole, candidates, max(2 * k, 8), salt)
            if not len(more):
                break
            candidates = np.vstack([candidates, more])
        if len(candidates) <= k:
            return candidates
        weights = _sums(_rdd(whole), candidates)[1]
        whole.unpersist()
        used = weights > 0
        centres = candidates[used] if used.sum() <= k else _thinned(candidates[used], weights[used], k, how.seed)
        seen, smooth, best, waited = np.zeros(len(centres)), None, np.inf, 0
        for step in range(ROUNDS * n_batches if how.steps is None else how.steps):
            batch = step % n_batches
            if batch not in apart:
                apart[batch] = _rdd(table.where(F.col("batch") == batch)).persist(StorageLevel.MEMORY_ONLY)  # it is on disk already
            total, counts, loss = _sums(apart[batch], centres)
            size = counts.sum()
            if not size:
                continue
            seen = counts if n_batches == 1 else seen + counts  # one batch: plain rounds over all rows
            share = np.divide(counts, seen, out=np.zeros_like(seen), where=seen > 0)[:, None]
            mean = np.divide(total, counts[:, None], out=centres.copy(), where=counts[:, None] > 0)
            moved = share * (mean - centres)
            centres = centres + moved
            smooth = loss / size if smooth is None else smooth + (loss / size - smooth) * 2 / (n_batches + 1)
            waited = 0 if smooth < best * (1 - 1e-4) else waited + 1
            best = min(best, smooth)
            if step + 1 >= n_batches and (waited >= how.patience or np.abs(moved).max() < 1e-9):
                break
        return centres
    finally:
        whole.unpersist()
        for own in apart.values():
            own.unpersist()


def assigned(rows: DataFrame, x: Column, centres: np.ndarray, out: str, distance: str | None = None) -> DataFrame:
    """``rows`` with the number of the nearest centre (the lowest on ties) of the array ``x``, in Arrow batches."""
    names, ids = rows.columns, np.arange(len(centres))

    def found(batches):
        for batch in batches:
            own = batch.column(len(names))
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            hit, squared = nearest(flat, ids, centres) if batch.num_rows else (ids[:0], np.empty(0))
            more = [pa.array(hit, pa.int64())] + ([] if distance is None else [pa.array(squared, pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, out] + ([] if distance is None else [distance]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    shape = f"{fields}, `{out}` bigint" + ("" if distance is None else f", `{distance}` double")
    return rows.select(*names, x.cast("array<double>").alias("_x")).mapInArrow(found, shape)
