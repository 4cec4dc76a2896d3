"""Seeded draws as Column expressions: a draw is a pure function of (seed, stream, draw number, row id).

The same seed gives the same rows under any partitioning, and every draw can be written in plain SQL: the first 52 bits of an
MD5 of the key, as a fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO52 = float(1 << 52)


def uniform(seed: int, stream: str, rid: Column, k: int = 0) -> Column:
    """A double in [0, 1)."""
    key = F.concat(F.lit(f"{seed}|{stream}|{k}|"), rid.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_TWO52)


def uniform_sql(seed: int, stream: str, rid: str, k: int = 0) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|{stream}|{k}|' || CAST({rid} AS VARCHAR)), 1, 13) AS BIGINT) / {_TWO52!r}::DOUBLE)"


def integer(u: Column, low: int | Column, high: int | Column) -> Column:
    """A long in [low, high] from a uniform draw."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(u * (high - low + 1))).cast("long")


def normal(u1: Column, u2: Column) -> Column:
    """A standard normal draw from two uniform ones (Box-Muller)."""
    return F.sqrt(-2.0 * F.ln(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """The value in whose share of the total weight the draw falls."""
    total, so_far, out = float(sum(weights)), 0.0, F.lit(values[-1])
    steps = []
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        so_far += w
        steps.append((so_far / total, v))
    for bound, v in reversed(steps):
        out = F.when(u < F.lit(bound), F.lit(v)).otherwise(out)
    return out


def fnv1a(text: str) -> int:
    """The 32-bit FNV-1a hash, for seeds of named streams and tables."""
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h
