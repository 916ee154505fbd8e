"""Reproducible randomness.

Every random choice is a function of a key and a seed, so a retried task or another
partitioning gives the same rows; md5 exists in other engines, so samples can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_DIGITS = 4  # 16 bits: at most 65536 slices
TURN = 6.283185307179586  # a full turn in radians


def random_key(key: Column, seed: int | str) -> Column:
    """32 hex digits that order rows at random."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def key_slice(random: Column) -> Column:
    """A prefix of the random key: ordered like it and evenly spread."""
    return F.substring(random, 1, SLICE_DIGITS)


def unit_from(random: Column, start: int = 1) -> Column:
    """A number in [0, 1) from 12 hex digits of a random key."""
    return F.conv(F.substring(random, start, 12), 16, 10).cast("double") / F.lit(float(16**12))


def _pair_keys(key: Column, size: int, seed: int | str) -> Column:
    """One random key per two numbers."""
    last = (size - 1) // 2
    return F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.md5(F.concat(key.cast("string"), F.lit(":"), i.cast("string"), F.lit(f"|{seed}"))),
    )


def uniform_array(key: Column, size: int, seed: int | str) -> Column:
    """Numbers in [0, 1)."""
    pairs = F.transform(_pair_keys(key, size, seed), lambda r: F.array(unit_from(r, 1), unit_from(r, 13)))
    return F.slice(F.flatten(pairs), 1, size)


def _box_muller(u: Column, w: Column) -> Column:
    return F.struct(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)).alias("r"), (F.lit(TURN) * w).alias("t"))


def _both_normals(polar: Column, size: int) -> Column:
    pairs = F.transform(polar, lambda z: F.array(z["r"] * F.cos(z["t"]), z["r"] * F.sin(z["t"])))
    return F.slice(F.flatten(pairs), 1, size)


def normal_array(key: Column, size: int, seed: int | str) -> Column:
    """Standard normal numbers by the Box-Muller transform."""
    polar = F.transform(_pair_keys(key, size, seed), lambda r: _box_muller(unit_from(r, 1), unit_from(r, 13)))
    return _both_normals(polar, size)


def noise_array(key: Column, size: int, seed: int) -> Column:
    """Standard normal numbers from Spark's own 64-bit hash: cheaper, for noise that no other
    engine has to reproduce."""

    def unit(i: Column, which: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i, F.lit(which), F.lit(seed)), 11)
        return bits.cast("double") / F.lit(float(2**53))

    last = (size - 1) // 2
    polar = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: _box_muller(unit(i, 0), unit(i, 1)))
    return _both_normals(polar, size)
