"""Steps whose cost must not grow with what is seldom needed, or faster than the table."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.functions.stats import distribution
from loomframe.operators import redraw, utility


def test_only_draws_that_are_needed_are_made(spark):
    rows = spark.range(30).select(F.col("id").alias("_rid"), F.lit("ann").alias("v"))
    bad = spark.createDataFrame([("ann",), ("bob",)], "v string")
    never = F.raise_error(F.lit("this draw is not needed")).cast("string")
    made, log = redraw.avoid(rows, "v", bad, [F.lit("Bob"), F.lit("cy"), F.lit("ann"), F.lit("eve"), *[never] * 4], 1)
    assert {r.v for r in made.collect()} == {"cy"} and {(r.draws, r.suffixes) for r in log.collect()} == {(2, 0)}
    later = [F.lit("ann")] * 6 + [F.lit("dee"), F.lit("bob")]
    made, log = redraw.avoid(rows, "v", bad, later, 1)
    assert {r.v for r in made.collect()} == {"dee"} and {(r.draws, r.suffixes) for r in log.collect()} == {(7, 0)}


@pytest.mark.parametrize("regression", [True, False])
def test_condensed_rows_weigh_as_all(spark, regression):
    draw = random.Random(3)
    n = 3 * 2 * utility.SHARES * 6
    rows = spark.createDataFrame([(float(draw.randrange(3)), float(draw.randrange(2)), float(draw.randrange(4))) for _ in range(n)], "a double, b double, y double").repartition(2)
    own = utility.condensed(rows, ["a", "b"], "y", regression).cache()
    sums = lambda d, w: {(r.a, r.b): tuple(round(x, 6) for x in (r.n, r.s, r.q)) for r in d.groupBy("a", "b").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("s"), F.sum(w * F.col("y") * F.col("y")).alias("q")).collect()}
    assert sums(own, F.col("_w")) == sums(rows, F.lit(1.0))
    assert own.count() <= 6 * utility.SHARES * (2 if regression else 4) < n or not regression


def test_place_among_quantiles(spark):
    def place(x, q):
        below, upto, n = sum(v < x for v in q), sum(v <= x for v in q), len(q)
        low, high = q[max(below, 1) - 1], q[min(below + 1, n) - 1]
        part = (x - low) / (high - low) if below == upto and high > low else 0.0
        return min((max(below - 1, 0) + part if below == upto else (below + upto - 1) / 2) / (n - 1), 1.0)

    for q in ([0.0, 1.0, 1.0, 1.0, 2.5, 9.0], [4.0, 4.0], [-1.0, 0.0, 3.0], [float(i * i) for i in range(101)]):
        xs = sorted({*q, *[v + 0.25 for v in q], q[0] - 1, q[-1] + 1})
        got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(distribution(F.col("x"), q).alias("p")).collect()]
        assert got == [place(x, q) for x in xs]
    assert spark.createDataFrame([(None,)], "x double").select(distribution(F.col("x"), [1.0, 2.0])).first()[0] == 0.0
