"""Invoices and bank statements as nested rows, money in whole cents, and their reconciliation."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from .folds import fold_in_order

CATALOGUE = (("Consulting hour", 9500), ("Site visit", 18000), ("Cable 10 m", 1250), ("Router", 8900), ("Desk lamp", 3400), ("Office chair", 14900), ("Paper box", 2100), ("Training day", 64000), ("License seat", 4900), ("Support month", 7500))
EVERYDAY = (("groceries", 5, 4200), ("transport", 3, 1500), ("dining", 3, 2600), ("health", 1, 5200), ("shopping", 2, 7800))


def invoices(spark: SparkSession, n: int, seed: int, tax_rate: float = 17.0, first: str = "2026-01-01", days: int = 365) -> DataFrame:
    """One row for each invoice: 1 to 8 different catalogue lines, subtotal, tax and total in cents."""
    rid = F.col("id")
    items = F.array(*[F.struct(rng.uniform(seed, "item", rid, k).alias("u"), F.lit(d).alias("description"), F.lit(p).cast("long").alias("unit_cents"), rng.integer(rng.uniform(seed, "qty", rid, k), 1, 12).alias("qty")) for k, (d, p) in enumerate(CATALOGUE)])
    count = rng.integer(rng.uniform(seed, "lines", rid), 1, 8).cast("int")
    lines = F.transform(F.slice(F.array_sort(items), F.lit(1), count), lambda x: F.struct(x["description"].alias("description"), x["qty"].alias("qty"), x["unit_cents"].alias("unit_cents"), (x["qty"] * x["unit_cents"]).alias("amount_cents")))
    issued = F.date_add(F.lit(first).cast("date"), F.floor(rng.uniform(seed, "day", rid) * days).cast("int"))
    base = spark.range(n).select(F.concat(F.lit("TEST-INV-"), F.lpad((rid + 1).cast("string"), 8, "0")).alias("number"), issued.alias("issued"), F.date_add(issued, rng.pick(rng.uniform(seed, "terms", rid), [7, 15, 30, 45])).alias("due"), lines.alias("lines"))
    subtotal = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["amount_cents"])
    priced = base.withColumn("subtotal_cents", subtotal).withColumn("tax_cents", F.floor(F.col("subtotal_cents") * tax_rate / 100 + 0.5).cast("long"))
    return priced.withColumn("total_cents", F.col("subtotal_cents") + F.col("tax_cents")).withColumn("synthetic", F.lit(True))


def check_invoices(df: DataFrame, tax_rate: float = 17.0) -> DataFrame:
    """One row: invoices, and those with a wrong line, subtotal, tax, total or date, and repeated numbers."""
    wrong_line = F.exists("lines", lambda x: x["amount_cents"] != x["qty"] * x["unit_cents"])
    subtotal = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["amount_cents"])
    bad = wrong_line | (subtotal != F.col("subtotal_cents")) | (F.floor(F.col("subtotal_cents") * tax_rate / 100 + 0.5) != F.col("tax_cents")) | (F.col("subtotal_cents") + F.col("tax_cents") != F.col("total_cents")) | (F.col("due") < F.col("issued"))
    return df.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("n_bad"), (F.count("*") - F.count_distinct("number")).alias("n_repeated"))


def invoice_lines(df: DataFrame) -> DataFrame:
    """A flat row for each line."""
    return df.select("number", "issued", "due", F.posexplode("lines").alias("line", "x"), "subtotal_cents", "tax_cents", "total_cents", "synthetic").select("number", "issued", "due", (F.col("line") + 1).alias("line"), "x.*", "subtotal_cents", "tax_cents", "total_cents", "synthetic")


def floor_fold(rows: DataFrame, account: str, order: list[str], cents: str, opening: int, floor: int, part: Column | None = None) -> DataFrame:
    """Running balances that never fall below `floor`: a debit that would is cut to what is left. `cents`: credits above, debits below 0.

    As balance = max(before + cents, floor), a balance is the running sum plus the largest of `opening` and all of floor - running
    sum so far. Both are taken within parts of an account (days of the first order column, by default) and then over the parts, so
    an account of any size is spread over its parts. A null amount moves nothing; of ties in `order` the debits come first.
    """
    if opening < floor:
        raise ValueError("the opening balance is below the floor")
    part = F.to_date(F.col(order[0])) if part is None else part
    base = rows.select(F.col(account).alias("_a"), part.alias("_p"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(cents).cast("long"), F.lit(0)).alias("_c"))
    inside = Window.partitionBy("_a", "_p").orderBy(*[f"_o{i}" for i in range(len(order))], "_c")
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    run = base.withColumn("_s", F.sum("_c").over(upto)).withColumn("_lack", F.lit(floor) - F.col("_s"))
    run = run.withColumns({"_m": F.max("_lack").over(upto), "_m0": F.max("_lack").over(before)})
    earlier = Window.partitionBy("_a").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = run.groupBy("_a", "_p").agg(F.sum("_c").alias("_t"), F.max("_lack").alias("_x"))
    starts = parts.withColumn("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).withColumn("_y", F.max(F.col("_x") - F.col("_b")).over(earlier))
    starts = starts.select(F.col("_a").alias("_a2"), F.col("_p").alias("_p2"), "_b", "_y")
    whole = run.join(starts, F.col("_a").eqNullSafe(F.col("_a2")) & F.col("_p").eqNullSafe(F.col("_p2")))
    after = F.col("_b") + F.col("_s") + F.greatest(F.lit(opening), "_y", F.col("_m") - F.col("_b"))
    ahead = F.col("_b") + F.col("_s") - F.col("_c") + F.greatest(F.lit(opening), "_y", F.col("_m0") - F.col("_b"))
    return whole.select(F.col("_a").alias(account), *[F.col(f"_o{i}").alias(c) for i, c in enumerate(order)], (after - ahead).alias("cents"), after.alias("balance"))


def floor_fold_refilled(rows: DataFrame, account: str, order: list[str], cents: str, refill: str, opening: int, floor: int, least: int = 1) -> DataFrame:
    """The rows with `moved` and `balance`: a debit that would breach `floor` is cut to what is left, or, where less than `least` is
    left, becomes a credit of the row's `refill`. Null amounts move nothing."""

    def step(balance: int, c: int | None, credit: int | None):
        c = c or 0
        if c < 0 and balance + c < floor:
            room = balance - floor
            c = -room if room >= max(1, least) else credit or 0
        return balance + c, (c, balance + c)

    return fold_in_order(rows, account, order, [cents, refill], lambda: opening, step, {"moved": ("bigint", pa.int64()), "balance": ("bigint", pa.int64())})


def statements(spark: SparkSession, n: int, per_statement: int, seed: int, first: str = "2026-01-01", days: int = 90, opening: int = 1_000_000, floor: int = 0) -> DataFrame:
    """(statement, day, seq, category, cents, balance): monthly salary and rent, everyday items, balances never under `floor`."""
    sid, k = F.col("statement"), F.col("seq")
    key = sid * 100_000 + k
    base = spark.range(n).select(F.col("id").alias("statement"), F.explode(F.sequence(F.lit(0), F.lit(per_statement - 1))).alias("seq"))
    day = F.when(k < 3, k * 30).otherwise(F.floor(rng.uniform(seed, "day", key) * days)).cast("int")
    category = F.when(k < 3, "salary").otherwise(rng.weighted(rng.uniform(seed, "category", key), [c for c, _, _ in EVERYDAY], [w for _, w, _ in EVERYDAY]))
    mean = F.lit(3000)
    for c, _, m in EVERYDAY:
        mean = F.when(category == c, m).otherwise(mean)
    cents = F.when(k < 3, F.lit(350_000)).otherwise(-F.floor(mean * (0.3 + 1.4 * rng.uniform(seed, "amount", key)))).cast("long")
    rows = base.select("statement", F.date_add(F.lit(first).cast("date"), day).alias("day"), "seq", category.alias("category"), cents.alias("cents"))
    return floor_fold(rows, "statement", ["day", "seq", "category"], "cents", opening, floor)


def statement_totals(rows: DataFrame, opening: int) -> DataFrame:
    return rows.groupBy("statement").agg(F.lit(opening).alias("opening_cents"), F.sum(F.when(F.col("cents") > 0, F.col("cents")).otherwise(0)).alias("credit_cents"), F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("debit_cents"), F.max_by("balance", F.struct("day", "seq")).alias("closing_cents"), F.min("balance").alias("lowest_cents"), F.count("*").alias("n"))


def check_statements(rows: DataFrame, opening: int, floor: int) -> DataFrame:
    """One row: transactions, balances that do not follow from the one before, and balances under the floor."""
    before = F.coalesce(F.lag("balance").over(Window.partitionBy("statement").orderBy("day", "seq")), F.lit(opening))
    return rows.withColumn("_off", F.col("balance") != before + F.col("cents")).agg(F.count("*").alias("n"), F.sum(F.col("_off").cast("long")).alias("n_off"), F.sum((F.col("balance") < floor).cast("long")).alias("n_under"))


def check_statement_limits(rows: DataFrame, statement: str, day: str, order: list[str], cents: str, balance: str, opening: int, floor: int | None = None, period: tuple[str, str] | None = None, least: int = 0, most: int | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """(statement, n, n_outside, n_amount, n_under, closing_off, count_off): rows outside the period, amounts outside their limits,
    balances under the floor, whether closing is opening plus all rows, and whether the number of rows is outside `counts`."""
    c, b = F.col(cents), F.col(balance)
    outside = ~F.col(day).between(*[F.lit(x).cast("date") for x in period]) if period else F.lit(False)
    amount = (F.abs(c) < least) | (F.abs(c) > most if most is not None else F.lit(False))
    n_of = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    found = rows.groupBy(statement).agg(F.count("*").alias("n"), n_of(outside).alias("n_outside"), n_of(amount).alias("n_amount"), n_of(b < floor if floor is not None else F.lit(False)).alias("n_under"), F.sum(c).alias("_s"), F.max_by(b, F.struct(*order)).alias("_closing"))
    return found.select(statement, "n", "n_outside", "n_amount", "n_under", (F.col("_closing") != F.lit(opening) + F.col("_s")).alias("closing_off"), (~F.col("n").between(*counts) if counts else F.lit(False)).alias("count_off"))


def invoice_stats(df: DataFrame, total: str, tax: str, n_lines: str) -> DataFrame:
    """One row: invoices, their sum and mean, their tax and their lines."""
    return df.agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.avg(total).alias("mean"), F.sum(tax).alias("tax"), F.sum(n_lines).alias("n_lines"))


def by_line_count(df: DataFrame, n_lines: str, most: int = 8) -> DataFrame:
    """(n_lines, n) for 1 to `most` lines, with 0 where no invoice has so many."""
    found = df.groupBy(F.col(n_lines).cast("long").alias("n_lines")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(1, most + 1).withColumnRenamed("id", "n_lines").join(found, "n_lines", "left").select("n_lines", F.coalesce("n", F.lit(0)).alias("n"))


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_period(text: str, today: date) -> tuple[date, date] | None:
    """last N days / weeks / months, last month (30 days), last year (365 days), Qn YYYY, a month with its year, or a year."""
    t = text.lower()
    if m := re.search(r"last (\d+) (day|week|month|year)s?", t):
        return today - timedelta(days=int(m[1]) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2]]), today
    if m := re.search(r"last (week|month|year)", t):
        return today - timedelta(days={"week": 7, "month": 30, "year": 365}[m[1]]), today
    if m := re.search(r"q([1-4])\s*(\d{4})", t):
        q, y = int(m[1]), int(m[2])
        end = date(y + (q == 4), q * 3 % 12 + 1, 1)
        return date(y, 3 * q - 2, 1), end - timedelta(days=1)
    if m := re.search(rf"({'|'.join(_MONTHS)})\s+(\d{{4}})", t):
        k, y = _MONTHS.index(m[1]) + 1, int(m[2])
        return date(y, k, 1), date(y + (k == 12), k % 12 + 1, 1) - timedelta(days=1)
    if m := re.search(r"\b(20\d{2})\b", t):
        return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
    return None


def parse_request(text: str, today: date) -> dict:
    """A statement's settings from a sentence: period, count, transactions, floor, opening balance."""
    t = text.lower().replace(",", "")
    number = lambda pattern: int(float(m[1]) * (1000 if m[2] == "k" else 1)) if (m := re.search(pattern, t)) else None
    return {"period": parse_period(text.replace(",", ""), today), "count": number(r"(\d+)()\s+statements?"), "transactions": number(r"(\d+)()\s+transactions?"), "floor": number(r"never (?:below|under|less than)\s+\D{0,4}(\d+(?:\.\d+)?)(k?)"), "opening": number(r"opening (?:balance )?(?:of )?\D{0,4}(\d+(?:\.\d+)?)(k?)")}
