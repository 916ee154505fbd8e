"""Expressions over array columns that hold vectors and fixed-shape tensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often or deep ``use`` refers to it.

    A plain reference inside a lambda may be inlined and so computed again per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(x: Column) -> Column:
    """Elements as float64, so sums do not depend on the stored width."""
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda u, v: u * v))


def l2_norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(x), lambda v: v * v)))


def slot_norms(slots: Column) -> Column:
    return F.transform(slots, l2_norm)


def flatten_tensor(x: Column, rank: int) -> Column:
    """Rank 1 (scalar per row) -> length-1 array, rank 2 -> as is, rank 3 -> one flat array."""
    if rank == 1:
        return F.array(x)
    if rank == 2:
        return x
    if rank == 3:
        return F.flatten(x)
    raise ValueError(f"rows of rank {rank} cannot be flattened; expected rank 1, 2 or 3")


def as_slots(x: Column, rank: int) -> Column:
    """Rank 2 -> a single slot, rank 3 -> as is."""
    if rank == 2:
        return F.array(x)
    if rank == 3:
        return x
    raise ValueError(f"rows of rank {rank} have no slots; expected rank 2 or 3")


def reshape(flat: Column, shape: tuple[int, ...]) -> Column:
    """Row-major reshape of a flat array; a wrong length fails the job."""
    size = reduce(lambda a, b: a * b, shape, 1)
    wrong = F.raise_error(F.lit(f"tensor does not have {size} elements"))
    return _nest(F.when(F.size(flat) == size, flat).otherwise(wrong), tuple(shape))


def _nest(flat: Column, shape: tuple[int, ...]) -> Column:
    if len(shape) <= 1:
        return flat
    step = reduce(lambda a, b: a * b, shape[1:], 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(shape[0] - 1)),
        lambda i: _nest(F.slice(flat, i * step + 1, F.lit(step)), shape[1:]),
    )


def squeeze_time(x: Column) -> Column:
    """Drop a leading axis of length one; another length fails the job."""
    return F.when(F.size(x) == 1, F.element_at(x, 1)).otherwise(
        F.raise_error(F.lit("expected exactly one frame on the time axis"))
    )


def zeros_like(x: Column) -> Column:
    return F.transform(x, lambda v: F.lit(0.0))


def round_elements(x: Column, decimals: int) -> Column:
    """Half-even rounding of each scaled element, as numerical libraries round."""
    scale = float(10**decimals)
    return F.transform(x, lambda v: F.rint(v.cast("double") * scale) / scale)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda u, v: u - v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a floored denominator, clipped to [-1, 1]; sizes must agree."""
    raw = dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(fixed.NORM_PRODUCT_FLOOR))
    clipped = F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))
    return F.when(F.size(a) == F.size(b), clipped).otherwise(
        F.raise_error(F.lit("vectors to compare differ in size")).cast("double")
    )


def mean_square(a: Column, b: Column) -> Column:
    return total(F.transform(difference(a, b), lambda v: v * v)) / F.size(a)


def mean_absolute(a: Column, b: Column) -> Column:
    return total(F.transform(difference(a, b), F.abs)) / F.size(a)


def psnr(mse: Column) -> Column:
    return F.lit(-10.0) * F.log10(F.greatest(mse, F.lit(fixed.MSE_FLOOR)))


def standardized(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std element-wise; a constant position gives 0."""
    centred = F.arrays_zip(doubles(x).alias("v"), mean.alias("m"), std.alias("s"))
    return F.transform(
        centred, lambda z: (z["v"] - z["m"]) / F.when(z["s"] > 0, z["s"]).otherwise(F.lit(1.0))
    )


def sequence_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda v: v.cast("string")), " ")


def offset_seconds(horizon: int, fps: float) -> Column:
    """The window offsets 0, 1/fps, ... (horizon of them) in seconds."""
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: i / F.lit(float(fps)))


def unit_interval(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
