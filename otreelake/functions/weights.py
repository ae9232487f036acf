"""Weights: a row's deterministic 32-bit hash, uniform over all integers, and the fractions that stand for its thresholds."""

from __future__ import annotations

import datetime as dt
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WEIGHT, MAX_WEIGHT = -(1 << 31), (1 << 31) - 1
_RANGE = float(MAX_WEIGHT - MIN_WEIGHT)


def weight(*columns: str | Column) -> Column:
    """Murmur3 with seed 42 over the indexed columns; nulls leave the hash as it is."""
    return F.hash(*columns)


def from_fraction(fraction: float) -> int:
    """The weight at a fraction of the range; beyond it, the nearest end."""
    return max(MIN_WEIGHT, min(MAX_WEIGHT, int(fraction * _RANGE + MIN_WEIGHT)))


def to_fraction(value: int) -> float:
    return (value - MIN_WEIGHT) / _RANGE


def fraction_column(value: Column) -> Column:
    return (value.cast("double") - F.lit(float(MIN_WEIGHT))) / F.lit(_RANGE)


def normalized(max_weight: Column, elements: Column, cube_size: int) -> Column:
    """A cube's normalised weight: below 1 the fraction of its maximum, for a leaf the desired over the actual size."""
    return F.when(max_weight < MAX_WEIGHT, fraction_column(max_weight)).otherwise(F.lit(float(cube_size)) / elements)


# The 32-bit Murmur3 of Spark's hash function, whose trailing bytes are mixed one by one as signed numbers.
_C1, _C2, _ROUND, _F1, _F2, _MASK = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35, 0xFFFFFFFF

#: Types whose literals are hashed here, by how their values are laid out.
HASHED = {"string": "bytes", "int": "<i", "smallint": "<i", "tinyint": "<i", "date": "<i", "float": "<f", "bigint": "<q", "double": "<d"}


def hash_of(value: object, kind: str, seed: int = 42) -> int:
    """What Spark's hash gives for a value of a type."""
    if kind == "string":
        data = value.encode()
    else:
        if kind == "date":
            value = (value - dt.date(1970, 1, 1)).days
        data = struct.pack(HASHED[kind], value + 0.0 if kind in ("float", "double") else value)  # -0.0 is 0.0
    h = seed & _MASK
    whole = len(data) // 4 * 4
    words = [*struct.unpack(f"<{whole // 4}I", data[:whole]), *(b - 256 & _MASK if b > 127 else b for b in data[whole:])]
    for k in words:
        k = k * _C1 & _MASK
        k = (k << 15 | k >> 17) * _C2 & _MASK
        h ^= k
        h = ((h << 13 | h >> 19) & _MASK) * 5 + _ROUND & _MASK
    h ^= len(data)
    h = (h ^ h >> 16) * _F1 & _MASK
    h = (h ^ h >> 13) * _F2 & _MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h
