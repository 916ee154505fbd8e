"""Trained networks on tables: data-parallel gradients, Adam on the driver's small weights.

Rows are packed once into blocks of matrices, dealt by a hash of the key, so neither batches nor
blocks depend on how the table is cut. A block holds unscaled features in the narrowest type that loses
nothing; they are scaled when they are read. Each batch is stored apart, so a step reads the rows of its
batch and no others, and a round reads every row once. A step sends the weights to the tasks, each of
which adds up the gradients of its blocks; where a batch has many tasks their sums are added in
groups, and one short vector per task or group reaches the driver. A tenth of the rows, also dealt by hash, is held out: its
loss comes with the first step of each round over the batches and stops a network that has not
improved for ``patience`` rounds. Every target has its own network, as has every feature set; all of them share the passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens import session

BLOCK_ROWS = 2048
BATCH_ROWS = 8192
MOST_BATCHES = 32
HELD_OUT = 10
SUM_GROUPS = 16
FILE_BLOCKS = 4  # of one batch, stored in one file
CACHE_ROWS = 512  # whose layers stay in a core's cache
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
KINDS = {1: "i1", 4: "<f4", 8: "<f8"}  # by bytes per number


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (64, 32)
    alpha: float = 1e-4
    rate: float = 5e-3
    rounds: int = 60
    patience: int = 6
    seed: int = 0


def narrowed(values: np.ndarray) -> bytes:
    """Numbers in the narrowest of ``KINDS`` that gives back the same numbers."""
    with np.errstate(all="ignore"):
        for kind in ("i1", "<f4"):
            short = values.astype(kind)
            if np.array_equal(short, values):
                return short.tobytes()
    return np.ascontiguousarray(values, "<f8").tobytes()


def blocks(rows: DataFrame, key: str, x: str | list[str], y: str, n: int, seed: int = 0, held_out: bool = True,
           block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS) -> tuple[DataFrame, int]:
    """Stored matrices of about ``block_rows`` rows (``batch``, ``n``, ``x``, ``y``) and the number of
    batches; the held-out rows are batch -1. ``x`` names a vector or several, each a matrix of its own,
    ``y`` an array of numbers. A batch is a folder of its own, so reading one batch opens no file of
    another. Large tables are shuffled some batches at a time."""
    xs = [x] if isinstance(x, str) else x
    names = [f"x{i}" for i in range(len(xs))]
    n_blocks = max(1, -(-n // block_rows))
    n_batches = min(MOST_BATCHES, max(1, n // batch_rows))
    dealt = F.xxhash64(F.lit(seed), F.col(key))
    block = F.pmod(dealt, F.lit(n_blocks)).cast("int")
    out = F.pmod(F.xxhash64(F.lit("held out"), F.lit(seed), F.col(key)), F.lit(HELD_OUT)) == 0
    own = F.pmod(block, F.lit(n_batches))
    keyed = rows.select(F.col(key).alias("key"), *[vector_to_array(c).alias(a) for c, a in zip(xs, names)],
                        F.col(y).cast("array<double>").alias("y"), block.alias("block"),
                        (F.when(out, -1).otherwise(own) if held_out else own).cast("int").alias("batch"))
    blocks_apart = F.when(F.col("batch") < 0, F.lit(FILE_BLOCKS * HELD_OUT)).otherwise(F.lit(FILE_BLOCKS * n_batches))
    placed = keyed.withColumn("file", F.floor(F.col("block") / blocks_apart).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        size = table.num_rows
        flat = {c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in (*names, "y")}
        return pa.table({"batch": pa.array([table["batch"][0].as_py()], pa.int32()), "n": pa.array([size], pa.int32()),
                         "x": pa.array([[narrowed(flat[c]) for c in names]], pa.list_(pa.binary())), "y": [narrowed(flat["y"])]})

    first = keyed.select(F.concat(*names, "y").alias("all")).first()
    parts = min(session.parts_of(n, 8 + len(first["all"] or ()) if first else 0), n_batches)

    def part(p: int) -> DataFrame:
        own = placed if parts == 1 else placed.where(F.pmod(F.col("batch"), F.lit(parts)) == p)
        return own.repartition("batch", "file").groupBy("batch", "file", "block").applyInArrow(packed, "batch int, n int, x array<binary>, y binary")

    return session.written_in_parts(rows.sparkSession, part, parts, by="batch").select("batch", "n", "x", "y"), n_batches


def start(sizes: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    """Weights and intercepts of each layer, uniform within the usual bounds of rectified units."""
    out = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (fan_in + fan_out))
        out += [rng.uniform(-bound, bound, (fan_in, fan_out)), rng.uniform(-bound, bound, fan_out)]
    return out


def forward(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Outputs of all layers, the input first."""
    out = [x]
    for i in range(0, len(weights), 2):
        value = out[-1] @ weights[i]
        value += weights[i + 1]
        out.append(value if i + 2 == len(weights) else np.maximum(value, 0.0, out=value))
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Sum over the rows of the gradient of half the squared error, flat, and of that error."""
    layers = forward(x, weights)
    delta = layers[-1] - y
    loss, parts = float(np.vdot(delta, delta)) / 2, []
    for i in range(len(weights) - 2, -1, -2):
        parts += [delta.sum(0), layers[i // 2].T @ delta]
        if i:
            delta = delta @ weights[i].T
            delta *= layers[i // 2] > 0
    return np.concatenate([p.ravel() for p in reversed(parts)]), loss


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return out


@dataclass(frozen=True)
class Net:
    """The feature set (its place among them) and the columns of ``y`` that one network maps to each other."""

    x: int
    y: tuple[int, int]


@dataclass(frozen=True)
class Features:
    """Width of a feature set, and the mean and deviation that it is scaled by, if it is."""

    width: int
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def read(self, raw: bytes, rows: int) -> np.ndarray:
        x = _numbers(raw, rows, self.width)
        return x.astype("<f8", copy=False) if self.mean is None else (x - self.mean) / self.std


def _numbers(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, KINDS[len(raw) // (rows * width)] if raw else "<f8").reshape(rows, width)


def _sum(a: tuple, b: tuple) -> tuple:
    return tuple([y if x is None else x if y is None else x + y for x, y in zip(p, q)] if isinstance(p, list) else p + q for p, q in zip(a, b))


def _passed(table: RDD, nets: list, plan: list[Net], sets: list[Features]) -> tuple:
    """Over the blocks of ``table``: training and held-out rows, losses of every network on both, and gradients, summed."""
    width = max(p.y[1] for p in plan)
    live = {p.x for net, p in zip(nets, plan) if net is not None}

    def summed(found):
        n, out_n, loss, out_loss, sums = 0, 0, np.zeros(len(nets)), np.zeros(len(nets)), [None] * len(nets)
        for batch, rows, raw_x, raw_y in found:
            xs = [own.read(raw, rows) if at in live else None for at, (own, raw) in enumerate(zip(sets, raw_x))]
            ys = _numbers(raw_y, rows, width).astype("<f8", copy=False)
            n, out_n = n + rows * (batch >= 0), out_n + rows * (batch < 0)
            for i, (net, span) in enumerate(zip(nets, plan)):
                if net is None:
                    continue
                x, y = xs[span.x], ys[:, slice(*span.y)]
                if batch < 0:
                    error = forward(x, net)[-1] - y
                    out_loss[i] += float(np.vdot(error, error)) / 2
                    continue
                for at in range(0, rows, CACHE_ROWS):
                    part, cost = gradient(x[at : at + CACHE_ROWS], y[at : at + CACHE_ROWS], net)
                    sums[i] = part if sums[i] is None else sums[i] + part
                    loss[i] += cost
        yield n, out_n, loss, out_loss, sums

    partial = table.mapPartitions(summed)
    if table.getNumPartitions() > SUM_GROUPS:
        partial = partial.mapPartitionsWithIndex(lambda i, own: ((i % SUM_GROUPS, one) for one in own)).reduceByKey(_sum, SUM_GROUPS).values()
    return reduce(_sum, partial.collect(), (0, 0, np.zeros(len(nets)), np.zeros(len(nets)), [None] * len(nets)))  # at most SUM_GROUPS rows


def train(table: DataFrame, n_batches: int, size: int, spans: list[tuple[int, int]], settings: Settings) -> list[list[np.ndarray]]:
    """Weights of one network per span of targets, all on the same ``size`` features."""
    return train_sets(table, n_batches, [Features(size)], spans, settings)[0]


def train_sets(table: DataFrame, n_batches: int, sets: list[Features], spans: list[tuple[int, int]], settings: Settings) -> list[list[list[np.ndarray]]]:
    """Per feature set (a vector of the blocks), weights of one network per span of targets, over the blocks of ``blocks``.

    Returned are the weights with the smallest held-out loss (of the training rows where none is held
    out). A set's networks do not depend on the other sets, which only share its passes.
    """
    plan, nets = [Net(at, span) for at in range(len(sets)) for span in spans], []
    for own in sets:
        rng = np.random.default_rng(settings.seed)
        nets += [start([own.width, *settings.hidden, b - a], rng) for a, b in spans]
    first = [np.zeros(sum(w.size for w in net)) for net in nets]
    second = [m.copy() for m in first]
    penalised = [np.concatenate([np.full(w.size, float(w.ndim == 2)) for w in net]) for net in nets]
    best, best_loss, waited = [None] * len(nets), [np.inf] * len(nets), [0] * len(nets)
    done = [False] * len(nets)
    apart = [table.where(F.col("batch") == b).select("batch", "n", "x", "y").rdd.map(tuple).persist(StorageLevel.MEMORY_ONLY) for b in range(-1, n_batches)]  # on disk they are already
    try:
        step = 0
        for _ in range(settings.rounds):
            for batch in range(n_batches):
                live = [None if stop else net for net, stop in zip(nets, done)]
                if batch == 0:  # with the held-out rows
                    before = [[w.copy() for w in net] for net in nets]
                    n, out_n, _, out_loss, sums = _passed(table.sparkSession.sparkContext.union(apart[:2]), live, plan, sets)
                    for i in range(len(nets)):
                        if done[i] or not out_n:
                            continue
                        held = out_loss[i] / out_n
                        improved = held < best_loss[i] * (1 - 1e-4)
                        waited[i] = 0 if improved else waited[i] + 1
                        if held < best_loss[i]:
                            best_loss[i], best[i] = held, before[i]
                        done[i] = waited[i] > settings.patience
                else:
                    n, _, _, _, sums = _passed(apart[1 + batch], live, plan, sets)
                step += 1
                for i, own in enumerate(sums):
                    if done[i] or own is None:
                        continue
                    flat = np.concatenate([w.ravel() for w in nets[i]])
                    g = own / n + settings.alpha * penalised[i] * flat / n
                    first[i] = BETA1 * first[i] + (1 - BETA1) * g
                    second[i] = BETA2 * second[i] + (1 - BETA2) * g * g
                    move = first[i] / (1 - BETA1**step) / (np.sqrt(second[i] / (1 - BETA2**step)) + EPSILON)
                    nets[i] = _shaped(flat - settings.rate * move, nets[i])
                if all(done):  # nothing can change any more
                    break
            if all(done):
                break
    finally:
        for one in apart:
            one.unpersist()
    chosen = [own if kept is None else kept for own, kept in zip(nets, best)]
    return [chosen[i : i + len(spans)] for i in range(0, len(chosen), len(spans))]


def predictions(rows: DataFrame, x: str, nets: list[list[np.ndarray]], shift: np.ndarray, scale: np.ndarray, out: str) -> DataFrame:
    """Outputs of all networks side by side, on the scale of the targets, in Arrow batches."""
    @F.pandas_udf("array<double>")
    def predict(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        own = np.stack(features.to_numpy())
        return pd.Series(list(np.hstack([forward(own, net)[-1] for net in nets]) * scale + shift))

    return rows.withColumn(out, predict(vector_to_array(x)))
