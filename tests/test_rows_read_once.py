"""Train on synthetic, test on real: what rows are worked out from is read once, and no join carries texts."""

import pytest
from pyspark.sql import functions as F

from loomframe.functions import rng
from loomframe.operators import utility
from loomframe.operators.infer import ColumnSpec
from loomframe.plans import generate_queries


def test_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    made = spark.range(400).select("id", counted(rng.uniform(5, "x", F.col("id"))).alias("x"))
    rows = made.select("id", "x", F.when(F.col("x") < 0.4, "low").otherwise("high").alias("y"), F.lit(None).alias("none"))
    specs = [
        ColumnSpec("id", "integer", "Identifier", "identifier", False, True), ColumnSpec("x", "float", "Other", "numeric"), ColumnSpec("y", "string", "Category", "categorical", False),
        ColumnSpec("none", "string", "Other", "text"),
    ]
    found = utility.tstr(rows, specs, "id", 3, "y")
    assert seen.value == 400 and found.n_train + found.n_test == 400 and found.real > 0.95


def test_texts_are_measured_below_the_join(spark, sf, monkeypatch):
    class Taken(Exception):
        pass

    def take(df, *_):
        raise Taken(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(utility, "tstr", take)
    with pytest.raises(Taken) as taken:
        generate_queries.tstr_documents(spark, sf)
    plan = str(taken.value)
    assert -1 < plan.index("Join") < plan.index("regexp_replace")
