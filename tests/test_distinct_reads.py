"""Cells are read once for each different text, however often it occurs, with the same results."""

import pytest
from pyspark.sql import functions as F

from loomframe.functions.dates import read_date, reads_as_date
from loomframe.operators import infer, validate

TEXTS = [
    "2024-02-29", "2024-02-31", "2024-1-5T7:08", "2024-01-05 07:08:09.5Z", "2024-01-05 07:08+05:30", "31/12/2024", "12/31/2024", "31/31/2024", "5.6.2024 9:30 PM", "5 March 2024", "Mar 5, 2024", "Foo 5, 2024",
    "", " ", "null", None, "12", "0012", "1,200.50", "$5", "a@b.co", "A@B.CO", "yes", "YES", "x" * 200, "2024", "12.5e3",
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) for _ in range(i % 4 + 1)], "i long, v string").cache()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_either_order_of_day_and_month(cells):
    v = F.col("v")
    assert not cells.where(~reads_as_date(v).eqNullSafe(F.when(v.isNotNull(), read_date(v).isNotNull() | read_date(v, False).isNotNull()))).count()


def test_shares_weigh_rows(cells):
    got = infer.type_shares(cells, ["v"]).first()
    clean = [t.strip() for t in (r.v for r in cells.collect()) if t is not None and t.strip().lower() not in ("", "null")]
    dates = {r.v.strip() for r in cells.where(read_date(F.col("v")).isNotNull() | read_date(F.col("v"), False).isNotNull()).collect()}
    assert (got.n_rows, got.n, got.n_distinct, got.n_lower) == (cells.count(), len(clean), len(set(clean)), len({t.lower() for t in clean}))
    assert got.date == sum(t in dates for t in clean) / len(clean) and got.boolean == sum(t.lower() == "yes" for t in clean) / len(clean)
    assert got.avg_length == sum(map(len, clean)) / len(clean)
    assert got.email == sum("@" in t for t in clean) / len(clean)


def test_no_row_is_multiplied_for_distinct_counts(cells):
    assert "Expand" not in _plan(infer.type_shares(cells, ["v"]))


def test_dates_are_read_after_counting(cells):
    found = validate.type_validity(cells, {"v": "date", "i": "integer"})
    plan = _plan(found).split("\n")
    reading, counting = (next(k for k, line in enumerate(plan) if word in line) for word in ("make_timestamp", "Aggregate [column"))
    assert counting <= reading and any("Aggregate [column" in line for line in plan[reading + 1 :]), "different texts are counted below the reading"
    v = F.col("v")
    wrong = cells.where(v.isNotNull() & ~F.lower(F.trim(v)).isin("", "null") & read_date(v).isNull() & read_date(v, False).isNull()).count()
    assert sorted(map(tuple, found.collect())) == [("i", cells.count(), 0), ("v", cells.where(v.isNotNull()).count(), wrong)]
    assert validate.type_validity(cells.limit(0), {"v": "date", "i": "integer"}).count() == 0
