"""Bank statements planned by account type: dated monthly items, everyday rows by a mix, and balances that keep a floor.

A statement's rows are planned before any balance is known: first the monthly items of all months of the period (a day that a month lacks
is its last one), as many as the count allows, then everyday rows on drawn days. All draws are functions of (statement, row), so
statements are planned without a shuffle; one stream over each statement's rows in order then cuts what would breach the floor, or
turns it into an incoming transfer.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from .documents import floor_fold_refilled


@dataclass(frozen=True)
class Item:
    """A kind of row: its direction (1 in, -1 out), the amounts it can have, its share among everyday rows or its day of the month."""

    category: str
    sign: int
    low: int
    high: int
    weight: float = 0.0
    day: int = 0


#: By account type; amounts in whole units of a currency at rate 1.
MIXES = {
    "checking": (
        Item("wage", 1, 1800, 4200, day=27), Item("rent", -1, 500, 1300, day=1),
        Item("food", -1, 6, 120, 34), Item("travel", -1, 4, 90, 16), Item("home", -1, 15, 220, 14), Item("leisure", -1, 5, 80, 14), Item("cash", -1, 20, 180, 8), Item("refund", 1, 10, 300, 8),
    ),
    "savings": (Item("interest", 1, 4, 50, day=31), Item("deposit", 1, 60, 900, 50), Item("withdrawal", -1, 40, 700, 40), Item("charge", -1, 1, 15, 10)),
    "business": (
        Item("payroll", -1, 5000, 22000, day=28), Item("lease", -1, 900, 5500, day=4),
        Item("sale", 1, 300, 11000, 38), Item("purchase", -1, 150, 5000, 30), Item("supplies", -1, 25, 800, 16), Item("freight", -1, 40, 500, 9), Item("duty", -1, 90, 2600, 7),
    ),
}


@dataclass(frozen=True)
class Plan:
    account: str = "checking"
    first: date = date(2026, 1, 1)
    last: date = date(2026, 3, 31)
    rows: int = 40
    opening: int = 100_000
    floor: int | None = None
    least: float | None = None
    most: float | None = None
    rate: float = 1.0

    def __post_init__(self):
        if self.last < self.first:
            raise ValueError("the period ends before it begins")
        if self.least is not None and self.most is not None and self.least > self.most:
            raise ValueError("the least amount is above the most")
        if self.floor is not None and self.opening < self.floor:
            raise ValueError("the opening balance is below the floor")


def monthly_dates(first: date, last: date, day: int) -> list[date]:
    """A day of every month of a period; in months without it their last day."""
    out, y, m = [], first.year, first.month
    while date(y, m, 1) <= last:
        at = date(y, m, min(day, calendar.monthrange(y, m)[1]))
        if first <= at <= last:
            out.append(at)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def fixed_rows(plan: Plan) -> list[tuple[date, Item]]:
    """The monthly items of the period in the order of their dates, no more than a statement has rows."""
    found = [(at, item) for item in MIXES[plan.account] if item.day for at in monthly_dates(plan.first, plan.last, item.day)]
    return sorted(found, key=lambda x: (x[0], x[1].day))[: plan.rows]


def bounds(item: Item, plan: Plan) -> tuple[int, int]:
    """Least and most cents of an item, at the plan's rate and within its limits."""
    clamp = lambda x: min(max(x, plan.least if plan.least is not None else x), plan.most if plan.most is not None else max(x, plan.least or x))
    return max(1, round(clamp(item.low * plan.rate) * 100)), max(1, round(clamp(item.high * plan.rate) * 100))


def _amount(u: Column, item: Item, plan: Plan) -> Column:
    low, high = bounds(item, plan)
    return rng.integer(u, low, high)


def planned(statements: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """(statement, seq, day, category, cents, refill): each statement's rows before balances; `statements` has a column of their ids."""
    fixed, mix = fixed_rows(plan), [x for x in MIXES[plan.account] if not x.day]
    given = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(at).alias("day"), F.lit(item.category).alias("category")) for k, (at, item) in enumerate(fixed)]) if fixed else F.array().cast("array<struct<seq:int,day:date,category:string>>")
    more = F.transform(F.sequence(F.lit(len(fixed)), F.lit(plan.rows - 1)), lambda k: F.struct(k.alias("seq"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("category"))) if plan.rows > len(fixed) else F.array().cast("array<struct<seq:int,day:date,category:string>>")
    rows = statements.select("statement", F.inline(F.concat(given, more)))
    key = F.concat_ws(":", F.col("statement").cast("string"), F.col("seq").cast("string"))
    u = lambda what: rng.uniform(seed, what, key)
    days = (plan.last - plan.first).days + 1
    everyday = F.date_add(F.lit(plan.first), rng.integer(u("day"), 0, days - 1).cast("int"))
    rows = rows.select("statement", "seq", F.coalesce("day", everyday).alias("day"), F.coalesce("category", rng.weighted(u("category"), [x.category for x in mix], [x.weight for x in mix])).alias("category"))
    cents = F.lit(None).cast("long")
    for item in MIXES[plan.account]:
        cents = F.when(F.col("category") == item.category, item.sign * _amount(u("amount"), item, plan)).otherwise(cents)
    credit = max((x for x in mix if x.sign > 0), key=lambda x: x.weight)
    return rows.select("statement", "seq", "day", "category", cents.alias("cents"), _amount(u("refill"), credit, plan).alias("refill"))


def statements(ids: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """(statement, seq, day, category, cents, balance): cents as they moved the balance. A row that became a transfer is named `transfer in`."""
    floor = plan.floor if plan.floor is not None else -(1 << 62)
    least = max(1, round((plan.least or 0.01) * 100))
    moved = floor_fold_refilled(planned(ids, plan, seed), "statement", ["day", "seq"], "cents", "refill", plan.opening, floor, least)
    turned = (F.col("cents") < 0) & (F.col("moved") > 0)
    return moved.select("statement", "seq", "day", F.when(turned, "transfer in").otherwise(F.col("category")).alias("category"), F.col("moved").alias("cents"), "balance")


def accounts(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(statement, number): test account numbers, all but four digits hidden."""
    digits = F.lpad(rng.integer(rng.uniform(seed, "account", F.col("id")), 0, 9999).cast("string"), 4, "0")
    return spark.range(n).select(F.col("id").alias("statement"), F.concat(F.lit("TEST-**** "), digits).alias("number"))
