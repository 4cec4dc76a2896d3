"""Statements planned by account type."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loomframe.operators import documents, ledger


def test_month_ends():
    assert ledger.monthly_dates(date(2024, 1, 31), date(2024, 4, 30), 31) == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 30)]
    assert ledger.monthly_dates(date(2025, 12, 5), date(2026, 1, 3), 4) == [] and ledger.monthly_dates(date(2025, 12, 4), date(2026, 1, 4), 4) == [date(2025, 12, 4), date(2026, 1, 4)]


@pytest.mark.parametrize("account", sorted(ledger.MIXES))
def test_statements(spark, account):
    plan = ledger.Plan(account, date(2026, 1, 10), date(2026, 3, 31), 35, 50_000, 10_000, 5.0, 900.0, 2.0)
    rows = ledger.statements(spark.range(30).select(F.col("id").alias("statement")), plan, 7).persist()
    assert documents.check_statements(rows, 50_000, 10_000).first().asDict() == {"n": 30 * 35, "n_off": 0, "n_under": 0}
    limits = documents.check_statement_limits(rows, "statement", "day", ["day", "seq"], "cents", "balance", 50_000, 10_000, ("2026-01-10", "2026-03-31"), 500, 90_000, (35, 35))
    # A debit that was cut to what was left may be under the least amount only if the floor asked for it, which it never does here.
    assert {k for r in limits.collect() for k, v in r.asDict().items() if k not in ("statement", "n") and v} == set()
    fixed = {x.category for x in ledger.MIXES[account] if x.day}
    kinds = {r.category for r in rows.collect()}
    assert kinds - {"transfer in"} <= {x.category for x in ledger.MIXES[account]} and len(kinds & fixed) >= 1
    wanted = len(ledger.fixed_rows(plan))
    assert all(r.n == wanted for r in rows.where(F.col("seq") < wanted).groupBy("statement").agg(F.count("*").alias("n")).collect())
    assert rows.unpersist() is not None


def test_refills_where_there_is_no_room(spark):
    plan = ledger.Plan("checking", rows=60, opening=1_000, floor=1_000, least=20.0)
    rows = ledger.statements(spark.range(20).select(F.col("id").alias("statement")), plan, 3)
    assert rows.where("category = 'transfer in'").count() > 20 and rows.where("category = 'transfer in' AND cents <= 0").count() == 0
    assert rows.where("balance < 1000").count() == 0


def test_free_balance_and_errors(spark):
    rows = ledger.statements(spark.range(5).select(F.col("id").alias("statement")), ledger.Plan("business", rows=3, opening=0), 1)
    assert rows.where("balance < 0").count() > 0 and rows.count() == 15
    for bad in ({"last": date(2020, 1, 1)}, {"least": 5.0, "most": 1.0}, {"floor": 10, "opening": 5}):
        with pytest.raises(ValueError):
            ledger.Plan(**bad)
    numbers = [r.number for r in ledger.accounts(spark, 9, 1).collect()]
    assert all(len(n) == 14 and n.startswith("TEST-**** ") for n in numbers)
