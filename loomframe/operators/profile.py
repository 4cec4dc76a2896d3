"""Profiles: counts, exact quantiles, top values, correlations, outliers, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_inv, normal_pdf, running_totals

PERCENTS = [i / 100 for i in range(101)]
TOP_CATEGORIES = 200
BINS = 20
#: Ranges that a column is cut into for exact order statistics.
PARTS = 64


def numeric_view(c: Column, kind: str) -> Column:
    """Numbers, or epoch milliseconds of dates; null, never NaN, for what is missing."""
    value = F.unix_millis(c.cast("timestamp")).cast("double") if kind in ("date", "datetime") else c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def long_form(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(column, value): all columns under each other in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each number occurs; nulls and NaN left out."""
    return long_form(df, columns).where("value IS NOT NULL AND NOT isnan(value)").groupBy("column", "value").agg(F.count("*").alias("n"))


def order_statistics(counts: DataFrame, at: list[float], parts: int = PARTS) -> DataFrame:
    """(column, k, q): exact quantiles with linear interpolation, from value counts.

    Each column's values are cut into ranges at approximate quantiles. The ranges' totals say in which range a rank lies, and only
    within it rows are summed up in order: no task holds more than one range of one column.
    """
    bounds = counts.groupBy("column").agg(F.percentile_approx("value", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("_b"))  # a row a column
    cut = counts.join(F.broadcast(bounds), "column").select("column", "value", "n", F.size(F.filter("_b", lambda b: b <= F.col("value"))).alias("_part"))
    order = Window.partitionBy("column").orderBy("_part")  # at most `parts` rows a column
    sums = cut.groupBy("column", "_part").agg(F.sum("n").alias("_s"))
    ranges = sums.select("column", "_part", (F.sum("_s").over(order) - F.col("_s")).alias("_start"), F.sum("_s").over(order).alias("_end"), F.sum("_s").over(Window.partitionBy("column")).alias("_all"))
    asked = ranges.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("k", "_p")).withColumn("_r", F.col("_p") * (F.col("_all") - 1))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), edge("_r").cast("long").alias("x")) for i, edge in ((0, F.floor), (1, F.ceil))])
    wanted = asked.select("column", "_part", "_start", "_end", "k", (F.col("_r") - F.floor("_r")).alias("f"), F.inline(sides)).where("_start <= x AND x < _end")
    inner = Window.partitionBy("column", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A pair of ranks for each column and quantile.
    placed = cut.withColumn("_upto", F.sum("n").over(inner)).join(F.broadcast(wanted), ["column", "_part"]).where("_start + _upto - n <= x AND x < _start + _upto")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("value")))
    return placed.groupBy("column", "k").agg((side(0) + F.max("f") * (side(1) - side(0))).alias("q"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: counts, range, mean, median, sample deviation (0 for one value), exact distinct values."""
    counts = value_counts(df, columns)
    facts = long_form(df, columns).groupBy("column").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count("value")).alias("n_null"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value")).alias("stddev"),
    )
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    middle = order_statistics(counts, [0.5]).select("column", F.col("q").alias("median"))
    joined = facts.join(distinct, "column", "left").join(middle, "column", "left")  # a row a column
    return joined.select("column", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max", "mean", "median", "stddev")


def quantiles(df: DataFrame, columns: list[str], at: list[float] = PERCENTS) -> DataFrame:
    """(column, k, q): exact quantiles with linear interpolation of all columns."""
    return order_statistics(value_counts(df, columns), at)


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df, columns, "string").groupBy("column").agg(F.avg(F.length("value")).alias("avg_length"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"))


def top_values(df: DataFrame, columns: list[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """(column, rank, value, n, pct of the non-null ones): the k most frequent values, ties by value."""
    counts = long_form(df, columns, "string").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), "column").select("column", "rank", "value", "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def pearson(a: Column, b: Column) -> Column:
    """r over the rows that have both values; null under three rows or without variance."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    scale = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(F.count(x) >= 3, F.covar_samp(x, y) / F.nullif(scale, F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[pearson(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def normal_scores(df: DataFrame, column: str) -> DataFrame:
    """(value, n, z): for each value its average rank among all rows as a normal score. Ranks are summed range by range."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("m"))
    upto = running_totals(counts, "value", ["n"])
    return upto.crossJoin(F.broadcast(total)).select("value", "n", normal_inv((F.col("n_upto") - F.col("n") + (F.col("n") - 1) / 2 + 0.5) / F.col("m")).alias("z"))


def category_scores(df: DataFrame, column: str) -> DataFrame:
    """(value, n, score): categories side by side by falling count; the mean of a normal variable over each one's slice."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "value")  # of at most a few hundred categories
    share = counts.select("value", "n", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy())).alias("hi"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("w"))
    edge = lambda p: F.coalesce(normal_pdf(normal_inv(p)), F.lit(0.0))
    low = F.when(F.col("hi") - F.col("w") < 1e-12, 0.0).otherwise(F.col("hi") - F.col("w"))
    high = F.when(F.col("hi") > 1 - 1e-12, 1.0).otherwise(F.col("hi"))
    return share.select("value", "n", ((edge(low) - edge(high)) / F.col("w")).alias("score"))


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, q1, q3, n_outliers): values beyond 1.5 interquartile ranges, where that range is above 0."""
    values = long_form(df, columns).where("value IS NOT NULL")
    ends = quantiles(df, columns, [0.25, 0.75])
    quart = ends.groupBy("column").agg(F.max(F.when(F.col("k") == 0, F.col("q"))).alias("q1"), F.max(F.when(F.col("k") == 1, F.col("q"))).alias("q3"))  # a row a column
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("q3") > F.col("q1")) & ((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach))
    return values.join(F.broadcast(quart), "column").groupBy("column", "q1", "q3").agg(F.sum(out.cast("long")).alias("n_outliers"))


def totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, cells, missing cells and their share, and outliers of the numeric columns given."""
    missing = [F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns]
    facts = df.agg(F.count("*").alias("n_rows"), (F.count("*") * len(df.columns)).alias("n_cells"), F.coalesce(sum(missing[1:], missing[0]), F.lit(0)).alias("n_missing"))
    far = outliers(df, columns).agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_outliers"))
    return facts.crossJoin(F.broadcast(far)).select("n_rows", "n_cells", "n_missing", (F.col("n_missing") / F.nullif("n_cells", F.lit(0))).alias("missing_rate"), "n_outliers")  # two single rows


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """(bin, n): equal bins of [low, high]; -1 and `bins` count what lies under and over."""
    x = F.col(column).cast("double")
    place = F.when(x < low, -1).when(x > high, bins).otherwise(F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins))))
    return df.where(x.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
