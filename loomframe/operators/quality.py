"""Quality scores from measured metrics: every dimension is a number from rows, or null where nothing was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import round_half_up


def dimensions(column_metrics: DataFrame, correlation_pairs: DataFrame | None = None, links: DataFrame | None = None, rules: DataFrame | None = None, totals: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(dimension, score), scores from 0 to 100 with one decimal, and `overall`, the mean of those measured.

    column_metrics: ks_d, tvd, null_gap, unique_extra (null unless unique), leaked (null unless private). correlation_pairs: drift.
    links: n_fk, n_null, n_orphans. rules: n_rows, n_passing. totals: n_parents, n_off. documents: n, n_bad.
    """
    fit = F.coalesce(1 - F.col("ks_d"), 1 - F.col("tvd"))
    base = column_metrics.agg(
        F.avg(fit).alias("fidelity"), F.avg((F.col("unique_extra") == 0).cast("double")).alias("uniqueness"), F.avg(F.when(F.col("null_gap").isNotNull(), F.greatest(F.lit(0.0), 1 - 2 * F.abs("null_gap")))).alias("null_distribution"), F.avg((F.col("leaked") == 0).cast("double")).alias("privacy"),
    )
    rows = [base.select(F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("s")) for n in base.columns])))]
    if correlation_pairs is not None:
        rows.append(correlation_pairs.agg((1 - F.avg("drift")).alias("s")).select(F.lit("correlation").alias("dimension"), "s"))
    if links is not None:
        rows.append(links.agg((F.sum(F.col("n_fk") - F.col("n_orphans")) / F.nullif(F.sum(F.col("n_fk") + F.col("n_null")), F.lit(0))).alias("s")).select(F.lit("referential").alias("dimension"), "s"))
    if rules is not None:
        rows.append(rules.agg((F.sum("n_passing") / F.nullif(F.sum("n_rows"), F.lit(0))).alias("s")).select(F.lit("business_rules").alias("dimension"), "s"))
    for name, found, n, bad in (("cross_table", totals, "n_parents", "n_off"), ("documents", documents, "n", "n_bad")):
        if found is not None:
            rows.append(found.agg((1 - F.sum(bad) / F.nullif(F.sum(n), F.lit(0))).alias("s")).select(F.lit(name).alias("dimension"), "s"))
    scored = reduce(DataFrame.unionByName, rows).select("dimension", round_half_up(F.when(F.col("s") < 0, 0.0).otherwise(F.col("s")) * 100, 1).alias("score"))
    # A handful of rows, gathered in one, so that the measures are worked out once and not again for their mean.
    found = scored.agg(F.collect_list(F.struct("dimension", "score")).alias("_rows"), round_half_up(F.avg("score"), 1).alias("_mean"))
    return found.select(F.inline(F.concat("_rows", F.array(F.struct(F.lit("overall").alias("dimension"), F.col("_mean").alias("score"))))))


def warnings(column_metrics: DataFrame) -> DataFrame:
    """(column, severity, title): the worst first, then by column."""
    tests = [("high", "Original values leaked", F.col("leaked") > 0), ("high", "Duplicate keys", F.col("unique_extra") > 0), ("medium", "Distribution differs", F.coalesce("ks_d", "tvd") > 0.2), ("low", "Null rate differs", F.abs("null_gap") > 0.05)]
    found = [column_metrics.where(test).select("column", F.lit(s).alias("severity"), F.lit(t).alias("title")) for s, t, test in tests]
    return reduce(DataFrame.unionByName, found)


def grouped_warnings(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "title").agg(F.array_join(F.sort_array(F.collect_set("column")), ",").alias("columns"), F.count("*").alias("n"))


def column_status(column_metrics: DataFrame) -> DataFrame:
    """(column, status): `issue` where a warning is high, `warning` where there is another one, else `ok`."""
    worst = warnings(column_metrics).groupBy("column").agg(F.max((F.col("severity") == "high").cast("int")).alias("_w"))
    return column_metrics.select("column").distinct().join(worst, "column", "left").select("column", F.when(F.col("_w") == 1, "issue").when(F.col("_w") == 0, "warning").otherwise("ok").alias("status"))


def linked(metrics: dict[str, DataFrame]) -> DataFrame:
    """The column metrics of several tables under each other, each column named `table.column`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m.withColumn("column", F.concat(F.lit(f"{t}."), "column")) for t, m in metrics.items()])
