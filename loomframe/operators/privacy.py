"""Privacy transforms: masks, hashes, Laplace noise, and a report of what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as T
from ..functions.stats import round_half_up

SENSITIVITY = 0.05


def allowed_transforms(kind: str) -> tuple[str, ...]:
    """The transforms that make sense for a type: numbers can get noise, other values can be masked."""
    return ("preserve", "noise" if kind in ("integer", "float") else "mask", "hash", "synthetic")


def mask(c: Column, semantic: str = "Other") -> Column:
    """The mask that fits a column's meaning, or what its values look like."""
    if semantic == "Email":
        return T.mask_email(c)
    if semantic in ("Phone", "Identifier"):
        return T.mask_last4(c)
    if semantic == "Person Name":
        return T.mask_name(c)
    return F.when(c.contains("@"), T.mask_email(c)).when(c.rlike("[0-9]{4}"), T.mask_last4(c)).otherwise(T.mask_text(c))


def laplace(u: Column, scale: float) -> Column:
    """A Laplace draw from a uniform one."""
    x = u - 0.5
    return -scale * F.sign(x) * F.ln(F.greatest(1 - 2 * F.abs(x), F.lit(1e-300)))


def noise(c: Column, rid: Column, seed: int, stream: str, low: float, high: float, epsilon: float = 1.0, digits: int = 2) -> Column:
    """Laplace noise for a range [low, high]; not below 0 if the range is not."""
    epsilon = min(10.0, max(0.1, epsilon))
    scale = ((high - low) * SENSITIVITY or 1.0) / epsilon
    value = c.cast("double") + laplace(rng.uniform(seed, stream, rid), scale)
    return round_half_up(F.greatest(value, F.lit(0.0)) if low >= 0 else value, digits)


def protect(df: DataFrame, transforms: dict[str, str], rid: str, seed: int = 1, semantics: dict[str, str] | None = None, ranges: dict[str, tuple[float, float]] | None = None, epsilon: float = 1.0) -> DataFrame:
    """Apply preserve, mask, hash or noise to columns, in one projection."""
    columns = []
    for name in df.columns:
        c, how = F.col(f"`{name}`"), transforms.get(name, "preserve")
        if how == "mask":
            c = mask(c.cast("string"), (semantics or {}).get(name, "Other"))
        elif how == "hash":
            c = T.hash16(c)
        elif how == "noise":
            c = noise(c, F.col(rid), seed, f"noise:{name}", *(ranges or {}).get(name, (0.0, 20.0)), epsilon)
        elif how not in ("preserve", "synthetic"):
            raise ValueError(f"unknown transform {how}")
        columns.append(c.alias(name))
    return df.select(*columns)


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, changed): cells that differ, by key."""
    left = before.select(key, *[F.col(c).cast("string").alias(f"_b{i}") for i, c in enumerate(columns)])
    both = left.join(after.select(key, *[F.col(c).cast("string").alias(f"_a{i}") for i, c in enumerate(columns)]), key)
    row = both.agg(*[F.sum((~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))).cast("long")).alias(f"_{i}") for i in range(len(columns))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("changed")) for i, c in enumerate(columns)])))
