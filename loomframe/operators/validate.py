"""Checks of a table by itself and of a synthetic table against its original."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import reads_as_date
from ..functions.stats import running_totals
from .infer import ColumnSpec
from .profile import correlations, long_form
from .rules import check as check_rules


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """A row as one text: numbers by value, booleans in lower case, texts trimmed, null as nothing."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        x = F.col(f"`{c}`")
        if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal"):
            x = x.cast("double")
        elif kinds[c] in ("timestamp", "date"):
            x = F.unix_millis(x.cast("timestamp"))
        return F.coalesce(F.trim(x.cast("string")), F.lit(""))

    return F.concat_ws("\u0001", *[one(c) for c in columns])


STATUS = ("passed", "warning", "failed")


DATED = ("date", "datetime")


def valid(c: Column, kind: str) -> Column:
    """Whether a text cell reads as a type; nulls do."""
    v = T.cell(c)
    return _reads(v, T.number(v), kind)


def _reads(v: Column, n: Column, kind: str) -> Column:
    """Whether a read cell, and the number in it, are of a type."""
    tests = {
        "integer": n.isNotNull() & (n == F.floor(n)), "float": n.isNotNull(), "boolean": F.lower(v).isin("true", "false", "yes", "no", "y", "n", "t", "f", "1", "0"), "uuid": v.rlike(T.UUID), "email": v.rlike(T.EMAIL),
    }
    tests |= {k: reads_as_date(v) for k in DATED}
    return v.isNull() | F.coalesce(tests.get(kind, F.lit(True)), F.lit(False))


def _typed(c: Column, held: str, kind: str) -> Column | None:
    """Whether the text of a value that Spark holds as a number, date or time reads as `kind`; None where the text itself must be read.

    A number's text is a literal, but for NaN, which is a missing cell, and the infinities, which are no numbers. The text of a date or time
    is an ISO one as long as its year has four digits.
    """
    if held in ("tinyint", "smallint", "int", "bigint") and kind in ("integer", "float"):
        return F.lit(True)
    if held == "double" and kind in ("integer", "float"):
        finite = F.abs(c) != float("inf")
        return F.coalesce(F.isnan(c) | (finite & (c == F.floor(c)) if kind == "integer" else finite), F.lit(True))
    if held in ("date", "timestamp", "timestamp_ntz") and kind in DATED:
        return F.coalesce(F.year(c).between(0, 9999), F.lit(True))
    return None


def type_validity(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, n_values, n_invalid): cells that do not read as their column's type.

    Dates in texts take long to read and repeat: their different texts are counted first and read once. All other columns are read in one
    aggregation, each by its own test only; numbers, dates and times that Spark holds as such are not made texts for it.
    """
    held = {c: t for c, t in df.dtypes if c in types}
    typed = {c: test for c, k in types.items() if (test := _typed(F.col(f"`{c}`"), held[c], k)) is not None}
    dated, other = [c for c, k in types.items() if k in DATED and c not in typed], [c for c, k in types.items() if k not in DATED or c in typed]
    text = lambda c: F.col(f"`{c}`").cast("string")
    out = []
    if other:
        read = df.select(*[x for i, c in enumerate(other) for x in ((F.col(f"`{c}`").alias(f"t{i}"), typed[c].alias(f"v{i}")) if c in typed else (text(c).alias(f"t{i}"), T.cell(text(c)).alias(f"v{i}")))])
        read = read.select("*", *[T.number(F.col(f"v{i}")).alias(f"n{i}") for i, c in enumerate(other) if types[c] in ("integer", "float") and c not in typed])
        wrong = [F.sum((~(F.col(f"v{i}") if c in typed else _reads(F.col(f"v{i}"), F.col(f"n{i}"), types[c]))).cast("long")) for i, c in enumerate(other)]
        row = read.agg(F.count("*").alias("_all"), *[F.count(f"t{i}").alias(f"a{i}") for i in range(len(other))], *[x.alias(f"b{i}") for i, x in enumerate(wrong)])
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("n_values"), F.col(f"b{i}").alias("n_invalid")) for i, c in enumerate(other)])
        out.append(row.where("_all > 0").select(F.inline(each)))
    if dated:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("t")) for c in dated])))
        counts = cells.groupBy("column", "t").agg(F.count("*").alias("w")).withColumn("v", T.cell(F.col("t")))
        out.append(counts.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("w"))), F.lit(0)).alias("n_values"), F.sum(F.when(_reads(F.col("v"), F.lit(None), "date"), 0).otherwise(F.col("w"))).alias("n_invalid")))
    return reduce(DataFrame.unionByName, out)


def worst(checks: DataFrame) -> DataFrame:
    """The checks and a last row `overall` with the worst status.

    The checks, a handful of rows, are gathered in one row, so that what they measure is worked out once and not again for the last row.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    names = [*checks.columns, *({"check", "status", "measured"} - set(checks.columns))]
    kinds = {"check": "string", "status": "string", "measured": "double"} | dict(checks.dtypes)
    whole = checks.select(*[F.col(c) if c in checks.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names], rank.alias("_rank"))
    found = whole.agg(F.collect_list(F.struct(*names)).alias("_rows"), F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.coalesce(F.max("_rank"), F.lit(1)).cast("int")).alias("_worst"))
    own = {"check": F.lit("overall"), "status": F.col("_worst")}
    overall = F.struct(*[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    return found.select(F.inline(F.concat("_rows", F.array(overall))))


def report(df: DataFrame, specs: list[ColumnSpec], requested: int, original: DataFrame | None = None, rule_list: tuple = ()) -> DataFrame:
    """(check, status, measured): one row a check, and the worst of them as `overall`; checks that need an original are left out without one.

    measured is rows for the row count, invalid cells, repeated keys, rows that break a rule, copied rows, leaked values, and the largest KS
    distance and total variation.
    """
    row = lambda d, name, status, x: d.select(F.lit(name).alias("check"), status.alias("status"), x.cast("double").alias("measured"))
    fail = lambda x: F.when(F.coalesce(x, F.lit(0)) > 0, "failed").otherwise("passed")
    n = F.col("n")
    out = [
        row(df.agg(F.count("*").alias("n")), "row count", F.when(n == requested, "passed").otherwise("failed"), n),
        row(type_validity(df, {s.name: s.type for s in specs}).agg(F.sum("n_invalid").alias("n")), "types", fail(n), n),
    ]
    keys, private = [s.name for s in specs if s.unique], [s.name for s in specs if s.privacy == "high"]
    if keys:
        out.append(row(uniqueness(df, keys).agg(F.sum("n_extra").alias("n")), "unique keys", fail(n), n))
    if rule_list:
        out.append(row(check_rules(df, list(rule_list)).select((F.col("n_rows") - F.col("n_passing")).alias("n")), "business rules", fail(n), n))
    if original is not None:
        out.append(row(copied_rows(df, original, [s.name for s in specs]).select(F.col("n_copied").alias("n")), "copied rows", fail(n), n))
        if private:
            out.append(row(leaks(df, original, private).agg(F.sum("n_leaked").alias("n")), "private values", fail(n), n))
        gap = lambda bad, worse: F.when(n <= bad, "passed").when(n <= worse, "warning").otherwise("failed")
        numeric, named = [s.name for s in specs if s.kind == "numeric"], [s.name for s in specs if s.kind == "categorical"]
        if numeric:
            out.append(row(reduce(DataFrame.unionByName, [ks_statistic(df, original, c).select("d") for c in numeric]).agg(F.max("d").alias("n")), "distributions", gap(0.1, 0.3), n))
        if named:
            out.append(row(reduce(DataFrame.unionByName, [total_variation(df, original, c).select("tvd") for c in named]).agg(F.max("tvd").alias("n")), "categories", gap(0.1, 0.3), n))
    return worst(reduce(DataFrame.unionByName, out))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: d, the largest gap between the two distribution functions, n, m, and the asymptotic p (1 for d = 0)."""
    side = lambda df, x, y: df.select(F.col(column).cast("double").alias("v"), F.lit(x).alias("ca"), F.lit(y).alias("cb")).where("v IS NOT NULL AND NOT isnan(v)")
    counts = side(a, 1, 0).unionAll(side(b, 0, 1)).groupBy("v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    totals = counts.agg(F.sum("ca").alias("n"), F.sum("cb").alias("m"))
    gaps = running_totals(counts, "v", ["ca", "cb"]).crossJoin(F.broadcast(totals))
    found = gaps.agg(F.max(F.abs(F.col("ca_upto") / F.col("n") - F.col("cb_upto") / F.col("m"))).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return found.withColumn("p", F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: tvd, half the summed differences of category shares, and the number of categories."""
    shares = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias(n))
    both = shares(a, "x").join(shares(b, "y"), "v", "full").select("v", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    totals = both.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    return both.crossJoin(F.broadcast(totals)).agg((F.sum(F.abs(F.col("x") / F.col("n") - F.col("y") / F.col("m"))) / 2).alias("tvd"), F.count("*").alias("n_categories"))


def moment_drift(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column, drift, status): the larger change of mean and deviation relative to max(|mean|, deviation)."""
    facts = lambda df, s: long_form(df, columns).groupBy("column").agg(F.avg("value").alias(f"m{s}"), F.stddev_samp("value").alias(f"d{s}"))
    scale = F.greatest(F.abs("m1"), F.col("d1"), F.lit(1e-12))
    drift = F.greatest(F.abs(F.col("m2") - F.col("m1")), F.abs(F.col("d2") - F.col("d1"))) / scale
    return facts(a, 1).join(facts(b, 2), "column").select("column", drift.alias("drift"), F.when(drift <= 0.1, "passed").when(drift <= 0.3, "warning").otherwise("failed").alias("status"))


def correlation_drift(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return correlations(a, columns).join(correlations(b, columns).withColumnRenamed("r", "r2"), ["a", "b"]).select("a", "b", F.col("r").alias("r1"), "r2", F.abs(F.col("r") - F.col("r2")).alias("drift"))


def copied_rows(synthetic: DataFrame, original: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows and n_copied, synthetic rows that stand in the original. Rows are compared as hashes of their whole text."""
    known = original.select(F.sha2(canonical(original, columns).cast("binary"), 256).alias("_h")).distinct().withColumn("_in", F.lit(1))
    return synthetic.select(F.sha2(canonical(synthetic, columns).cast("binary"), 256).alias("_h")).join(known, "_h", "left").agg(F.count("*").alias("n_rows"), F.count("_in").alias("n_copied"))


def leaks(synthetic: DataFrame, original: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, n_leaked): private values that stand in the original, trimmed and in lower case, all columns in one join."""
    key = lambda df: long_form(df, columns, "string").select("column", F.lower(F.trim("value")).alias("v")).where("v <> ''")
    return key(synthetic).join(key(original).distinct().withColumn("_in", F.lit(1)), ["column", "v"], "left").groupBy("column").agg(F.count("*").alias("n_values"), F.count("_in").alias("n_leaked"))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_extra): repeats beyond the first of non-null values."""
    return long_form(df, columns, "string").groupBy("column").agg((F.count("value") - F.count_distinct("value")).alias("n_extra"))


def null_rates(df: DataFrame, columns: list[str], target: float) -> DataFrame:
    """(column, rate, status): null rates against a target, within max(0.01, three standard errors)."""
    found = long_form(df, columns, "string").groupBy("column").agg(F.avg(F.col("value").isNull().cast("double")).alias("rate"), F.count("*").alias("_n"))
    p = max(target, 0.001)
    allowed = F.greatest(F.lit(0.01), 3 * F.sqrt(F.lit(p * (1 - p)) / F.col("_n")))
    return found.select("column", "rate", F.when(F.abs(F.col("rate") - target) <= allowed, "passed").otherwise("warning").alias("status"))


def null_gaps(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate_a, rate_b, null_gap): how far the null rates of two tables are apart."""
    rates = lambda df, n: long_form(df, columns, "string").groupBy("column").agg(F.avg(F.col("value").isNull().cast("double")).alias(n))
    return rates(a, "rate_a").join(rates(b, "rate_b"), "column").select("column", "rate_a", "rate_b", (F.col("rate_a") - F.col("rate_b")).alias("null_gap"))


def statement_check(ledger: DataFrame, account: str, order: list[str], credit: Column, debit: Column, balance: Column | None = None) -> DataFrame:
    """Rows with running_balance and out_of_order, summed within each account."""
    from pyspark.sql import Window

    w = Window.partitionBy(account).orderBy(*order)
    return ledger.withColumns({"running_balance": F.sum(credit - debit).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "out_of_order": F.coalesce(F.col(order[0]) < F.lag(order[0]).over(w), F.lit(False))})


def tolerance_tvd(categories: int, n: int, m: int) -> float:
    return max(0.1, 1.5 * math.sqrt(categories / (2 * math.pi) * (1 / n + 1 / m)))
