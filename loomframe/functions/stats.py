"""The normal distribution and quantile functions as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26 (error function) and Acklam's inverse normal.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
INV_LOW = 0.02425


def _horner(x, coefficients, lit):
    out = lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + F.lit(ERF_P) * F.abs(z) / math.sqrt(2))
    tail = _horner(t, ERF_A[::-1], F.lit) * t * F.exp(-z * z / 2)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_inv(p: Column) -> Column:
    """The inverse of the distribution function for 0 < p < 1, null elsewhere."""
    inside = F.when((p > 0) & (p < 1), p)
    q = inside - 0.5
    middle = _horner(q * q, INV_A, F.lit) * q / (_horner(q * q, INV_B, F.lit) * q * q + 1)
    tail = F.sqrt(-2.0 * F.ln(F.least(inside, 1 - inside)))
    outer = _horner(tail, INV_C, F.lit) / (_horner(tail, INV_D, F.lit) * tail + 1)
    return F.when(inside < INV_LOW, outer).when(inside > 1 - INV_LOW, -outer).otherwise(middle)


def _sql_horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf_sql(z: str) -> str:
    t = f"(1e0 / (1e0 + {ERF_P!r}::DOUBLE * abs({z}) / {math.sqrt(2)!r}::DOUBLE))"
    tail = f"({_sql_horner(t, ERF_A[::-1])} * {t} * exp(-{z} * {z} / 2e0))"
    return f"(CASE WHEN {z} >= 0 THEN 1e0 - {tail} / 2e0 ELSE {tail} / 2e0 END)"


def normal_inv_sql(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    q2 = f"({q} * {q})"
    middle = f"({_sql_horner(q2, INV_A)} * {q} / ({_sql_horner(q2, INV_B)} * {q2} + 1e0))"
    tail = f"sqrt(-2e0 * ln(least({p}, 1e0 - {p})))"
    outer = f"({_sql_horner(tail, INV_C)} / ({_sql_horner(tail, INV_D)} * {tail} + 1e0))"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {INV_LOW} THEN {outer} WHEN {p} > {1 - INV_LOW!r} THEN -{outer} ELSE {middle} END)"


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def quantile_function(u: Column, quantiles: list[float]) -> Column:
    """Piecewise linear through evenly spaced quantiles."""
    n = len(quantiles) - 1
    table = F.array(*[F.lit(float(q)) for q in quantiles])
    at = F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    low, high = F.element_at(table, at + 1), F.element_at(table, at + 2)
    return low + (u * n - at) * (high - low)


def distribution(x: Column, quantiles: list[float]) -> Column:
    """Where x lies among evenly spaced quantiles, from 0 to 1: the middle of the steps that it spans. Found by halving, a few comparisons a row."""
    q, n = [float(v) for v in quantiles], len(quantiles)

    def step(below: int) -> Column:
        """The steps under x, with `below` quantiles less than it."""
        if below == n:
            return F.lit(float(n - 1))
        upto = sum(v <= q[below] for v in q)
        between = F.lit(float(below - 1)) + (x - q[below - 1]) / (q[below] - q[below - 1]) if below and q[below] > q[below - 1] else F.lit(float(max(below - 1, 0)))
        return F.when(x == q[below], (below + upto - 1) / 2).otherwise(between)

    def halved(low: int, high: int) -> Column:
        if low == high:
            return step(low)
        middle = (low + high) // 2
        return F.when(x > q[middle], halved(middle + 1, high)).otherwise(halved(low, middle))

    return F.least(halved(0, n) / (n - 1), F.lit(1.0))


def running_totals(df: DataFrame, order: str, values: list[str], parts: int = 64) -> DataFrame:
    """Add <value>_upto: the sum over all rows up to this one in the order of a numeric column without repeats.

    The rows are cut into ranges by approximate quantiles; each range is summed by itself and starts at the total of the ranges before
    it, so no task sees more than a range.
    """
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if df.columns else []
    table = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    cut = df.withColumn("_part", F.size(F.filter(table, lambda b: b <= F.col(order))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])  # at most `parts` rows
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values])
    inner = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.select("*", *[F.sum(v).over(inner).alias(f"_o_{v}") for v in values]).join(F.broadcast(starts), "_part")
    return own.select(*df.columns, *[(F.col(f"_s_{v}") + F.col(f"_o_{v}")).alias(f"{v}_upto") for v in values])
