"""Linear algebra over wide feature vectors: products with the covariance, never the covariance itself.

Rows are packed into blocks (sparse rows as index and value lists, dense rows as a matrix). One
pass multiplies the scatter matrix of all rows, centred, with a few columns: every task adds up
its blocks, tasks are added in groups, and only a matrix of width times columns reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.session import written

BLOCK_NUMBERS = 1 << 20
SUM_GROUPS = 16
BLOCK_SHAPE = "n int, dense boolean, ends binary, at binary, x binary, y binary"


class Rows:
    """A block of rows, dense or sparse, that multiplies from both sides."""

    def __init__(self, n: int, size: int, dense: bool, ends: bytes, at: bytes, x: bytes, y: bytes):
        self.n, self.size, self.y = n, size, np.frombuffer(y, "<f8").reshape(n, -1)
        values = np.frombuffer(x, "<f8")
        if dense:
            self.matrix = values.reshape(n, size)
            return
        self.matrix, self.values, self.at = None, values, np.frombuffer(at, "<i4")
        self.row = np.repeat(np.arange(n), np.diff(np.frombuffer(ends, "<i8"), prepend=0))

    def times(self, right: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix @ right
        return np.column_stack([np.bincount(self.row, self.values * right[self.at, j], self.n) for j in range(right.shape[1])])

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix.T @ right
        return np.column_stack([np.bincount(self.at, self.values * right[self.row, j], self.size) for j in range(right.shape[1])])

    def squares(self) -> np.ndarray:
        if self.matrix is not None:
            return (self.matrix**2).sum(0)
        return np.bincount(self.at, self.values**2, self.size)


class Packed:
    """Stored blocks of a vector column ``x`` and an array column ``y`` (may be empty)."""

    def __init__(self, rows: DataFrame, x: str, y: str | None = None):
        self.size = rows.select(x).first()[0].size
        targets = F.array().cast("array<double>") if y is None else F.col(y).cast("array<double>")
        limit = BLOCK_NUMBERS

        def packed(batches):
            for batch in batches:
                vectors, ys = batch.column(0), batch.column(1)
                start, held = 0, 0
                for i in range(batch.num_rows):
                    held += len(vectors[i]["values"].values)
                    if held >= limit or i == batch.num_rows - 1:
                        yield _block(vectors.slice(start, i + 1 - start), ys.slice(start, i + 1 - start))
                        start, held = i + 1, 0

        table = rows.select(F.col(x).alias("x"), targets.alias("y")).mapInArrow(packed, BLOCK_SHAPE)
        self.table = written(rows.sparkSession, table)

    def __enter__(self) -> Packed:
        self.table = self.table.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *_) -> None:
        self.table.unpersist()

    def total(self, of: Callable[[Rows], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``of`` over all blocks."""
        size = self.size

        def summed(batches):
            out = np.zeros(shape)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    out += of(Rows(row["n"], size, row["dense"], row["ends"], row["at"], row["x"], row["y"]))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sum"])

        def added(group: pa.Table) -> pa.Table:
            return pa.table({"sum": [np.sum([np.frombuffer(v, "<f8") for v in group["sum"].to_pylist()], 0).tobytes()]})

        parts = self.table.mapInArrow(summed, "sum binary")
        if self.table.rdd.getNumPartitions() > SUM_GROUPS:
            parts = parts.withColumn("g", F.spark_partition_id() % SUM_GROUPS).groupBy("g").applyInArrow(added, "sum binary")
        return np.sum([np.frombuffer(r[0], "<f8") for r in parts.collect()], 0).reshape(shape)  # at most SUM_GROUPS rows

    def moments(self, targets: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Count, mean of ``x``, sums of squares of ``x``, and mean of ``y``."""
        d = self.size
        found = self.total(lambda b: np.concatenate([[b.n], b.transposed_times(np.ones((b.n, 1)))[:, 0], b.squares(), b.y.sum(0)[:targets]]), (1 + 2 * d + targets,))
        n = found[0]
        return n, found[1 : d + 1] / n, found[d + 1 : 2 * d + 1], found[2 * d + 1 :] / n

    def scatter_times(self, right: np.ndarray, n: float, mean: np.ndarray) -> np.ndarray:
        """Centred scatter matrix times ``right``, in one pass."""
        product = self.total(lambda b: b.transposed_times(b.times(right)), right.shape)
        return product - n * np.outer(mean, mean @ right)


def products(rows: DataFrame, x: str, weights: np.ndarray, constants: np.ndarray, out: str) -> DataFrame:
    """``rows`` without ``x``, plus ``out``: the vector times the weights, plus the constants; sparse vectors stay sparse."""
    kept = rows.drop(x)
    names, size = kept.columns, len(weights)

    def multiplied(batches):
        for batch in batches:
            vectors = batch.column(len(names))
            none = pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))
            start, held = 0, 0
            for i in range(batch.num_rows):
                held += len(vectors[i]["values"].values)
                if held >= BLOCK_NUMBERS or i == batch.num_rows - 1:
                    n = i + 1 - start
                    row = {c: v[0] for c, v in _block(vectors.slice(start, n), none.slice(start, n)).to_pydict().items()}
                    found = Rows(n, size, row["dense"], row["ends"], row["at"], row["x"], row["y"]).times(weights) + constants
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(start, n) for j in range(len(names))), pa.array(found.tolist(), pa.list_(pa.float64()))], names=[*names, out])
                    start, held = i + 1, 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return rows.select(*names, x).mapInArrow(multiplied, f"{fields}, `{out}` array<double>")


def _block(vectors: pa.Array, ys: pa.Array) -> pa.RecordBatch:
    types, sizes, at, values = (vectors.field(i) for i in range(4))
    n = len(vectors)
    dense = all(t == 1 for t in types.to_pylist())
    if dense:
        ends, places, numbers = b"", b"", np.concatenate([np.asarray(v.values) for v in values]) if n else np.empty(0)
    else:
        ids, parts = [], []
        for kind, own_at, own in zip(types.to_pylist(), at, values):
            own = np.asarray(own.values)
            ids.append(np.arange(len(own)) if kind == 1 else np.asarray(own_at.values))
            parts.append(own)
        ends = np.cumsum([len(p) for p in parts]).astype("<i8").tobytes()
        places, numbers = np.concatenate(ids).astype("<i4").tobytes(), np.concatenate(parts)
    targets = np.concatenate([np.asarray(y.values) for y in ys]) if n else np.empty(0)
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int32()), pa.array([dense]), pa.array([ends]), pa.array([places]), pa.array([numbers.astype("<f8").tobytes()]), pa.array([targets.astype("<f8").tobytes()])],
        names=["n", "dense", "ends", "at", "x", "y"])


def ridge(rows: DataFrame, x: str, y: str, targets: int, alpha: float, tolerance: float = 1e-10, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a ridge regression on wide features, for all targets at once.

    Conjugate gradients, scaled by the diagonal; a round is one pass over the rows, whatever the
    number of targets, and ends when every target's residual is below ``tolerance`` of its start.
    """
    with Packed(rows, x, y) as packed:
        n, mean, squares, y_mean = packed.moments(targets)
        residual = packed.total(lambda b: b.transposed_times(b.y), (packed.size, targets)) - n * np.outer(mean, y_mean)
        diagonal = np.maximum(squares - n * mean**2, 0) + alpha
        diagonal = np.where(diagonal > 0, diagonal, 1.0)[:, None]
        weights = np.zeros_like(residual)
        goal = tolerance * np.sqrt((residual**2).sum(0))
        step = residual / diagonal
        fit = (residual * step).sum(0)
        for _ in range(rounds):
            live = np.sqrt((residual**2).sum(0)) > goal
            if not live.any():
                break
            ahead = packed.scatter_times(step[:, live], n, mean) + alpha * step[:, live]
            length = fit[live] / np.maximum((step[:, live] * ahead).sum(0), np.finfo(float).tiny)
            weights[:, live] += length * step[:, live]
            residual[:, live] -= length * ahead
            scaled = residual / diagonal
            now = (residual * scaled).sum(0)
            step[:, live] = scaled[:, live] + now[live] / np.maximum(fit[live], np.finfo(float).tiny) * step[:, live]
            fit = now
    return weights, y_mean - mean @ weights


def principal_axes(rows: DataFrame, x: str, k: int, seed: int = 0, spare: int = 8, tolerance: float = 1e-9, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (size x k) of largest variance, their variances, and the mean, by a randomized range finder.

    Each round multiplies the covariance with ``k + spare`` columns in one pass; it ends when the
    leading variances stand still. Axes point to the side of their largest loading.
    """
    with Packed(rows, x) as packed:
        n, mean, _, _ = packed.moments(0)
        columns = min(k + spare, packed.size)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(packed.size, columns)))[0]
        before = None
        for _ in range(rounds):
            product = packed.scatter_times(basis, n, mean)
            variances, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
            order = np.argsort(variances)[::-1][:k]
            axes, lead = basis @ turn[:, order], variances[order]
            off = product @ turn[:, order] - axes * lead  # how far the axes are from being exact
            if before is not None and np.abs(lead - before).max() <= tolerance * max(lead[0], np.finfo(float).tiny) and (
                    np.sqrt((off**2).sum(0)).max() <= np.sqrt(tolerance) * max(lead[0], np.finfo(float).tiny)):
                break
            before, basis = lead, np.linalg.qr(product)[0]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes * np.where(signs == 0, 1, signs), lead / max(n - 1, 1), mean
