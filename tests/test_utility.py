"""Train on synthetic, test on real, on rows with known relations; categories keep theirs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import rng
from loomframe.operators import generate, utility
from loomframe.operators.infer import ColumnSpec

SPECS = [
    ColumnSpec("customer_id", "integer", "Identifier", "identifier", False, True), ColumnSpec("full_name", "string", "Person Name", privacy="high"), ColumnSpec("age", "integer", "Age", "numeric"), ColumnSpec("tenure", "integer", "Other", "numeric"),
    ColumnSpec("contract", "string", "Category", "categorical"), ColumnSpec("charges", "float", "Currency", "numeric"), ColumnSpec("calls", "integer", "Quantity", "numeric"), ColumnSpec("partner", "boolean", "Category", "boolean"),
    ColumnSpec("churned", "boolean", "Category", "boolean"), ColumnSpec("noise", "string", "Category", "categorical"),
]


@pytest.fixture(scope="module")
def churn(spark):
    """Monthly contracts, short tenure, high bills and many calls churn more; noise is related to nothing."""
    u = lambda s: rng.uniform(11, s, F.col("id"))
    z = lambda s: rng.normal(u(s), u(s + "'"))
    rows = spark.range(3000).withColumn("contract", F.when(u("c") < 0.5, "month-to-month").when(u("d") < 0.6, "one-year").otherwise("two-year"))
    monthly = F.col("contract") == "month-to-month"
    rows = rows.withColumns({
        "tenure": F.greatest(F.lit(1), F.round(F.when(monthly, 12 + 10 * z("t")).otherwise(40 + 15 * z("t"))).cast("int")), "charges": F.round(40 + 80 * u("m"), 2), "calls": F.greatest(F.lit(0), F.round(2 + 1.5 * z("k")).cast("int")),
    })
    logit = -1 + F.when(monthly, 1.8).otherwise(-1.2) - 0.05 * F.col("tenure") + 0.025 * (F.col("charges") - 80) + 0.35 * (F.col("calls") - 2)
    return rows.select(
        (F.col("id") + 1000).alias("customer_id"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("full_name"), F.round(38 + 12 * z("a")).cast("int").alias("age"), "tenure", "contract", "charges", "calls",
        (u("p") < 0.5).alias("partner"), (u("y") < 1 / (1 + F.exp(-logit))).alias("churned"), F.when(u("n") < 0.5, "a").otherwise("b").alias("noise"),
    ).persist()


def test_targets_and_reasons(churn):
    found, why = utility.targets(SPECS, utility.target_facts(churn, [s.name for s in SPECS]))
    assert found[0].column == "churned" and found[0].task == "binary" and "two values" in found[0].reasons
    assert {t.column: t.task for t in found}["tenure"] == "regression" and {t.column: t.task for t in found}["contract"] == "classes"
    assert why == {"customer_id": "identifies rows", "full_name": "personal"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_churn_keeps_its_skill(churn, seed):
    found = utility.tstr(churn, SPECS, "customer_id", seed)
    assert (found.target, found.metric) == ("churned", "auc") and found.real > 0.8 and found.utility >= 0.85, found
    assert not {"customer_id", "full_name", "churned"} & set(found.features) and set(found.excluded) >= {"customer_id", "full_name"}
    assert found.n_train + found.n_test == 3000 and abs(found.n_test - 750) < 100


def test_numbers_and_classes(churn):
    tenure, contract = (utility.tstr(churn, SPECS, "customer_id", 7, t) for t in ("tenure", "contract"))
    assert tenure.metric == "r2" and tenure.utility > 0.5 and contract.metric == "accuracy" and contract.utility > 0.4, (tenure, contract)


def test_no_skill_no_utility(churn):
    found = utility.tstr(churn, SPECS, "customer_id", 3, "noise")
    assert found.utility is None and found.rating == "n/a"
    with pytest.raises(ValueError, match="personal"):
        utility.tstr(churn, SPECS, "customer_id", 3, "full_name")


def gap(df):
    rates = {r["m"]: r["y"] for r in df.groupBy((F.col("contract") == "month-to-month").alias("m")).agg(F.avg(F.col("churned").cast("string").isin("true").cast("double")).alias("y")).collect()}
    return rates[True] - rates[False]


def test_categories_keep_their_relation(spark, churn):
    profile = generate.learn(churn, SPECS)
    i, j = profile.latent.index("contract"), profile.latent.index("churned")
    assert abs(profile.matrix[i, j]) > 0.3
    made = generate.cells(spark, SPECS, 4000, 5, profile)
    real = gap(churn)
    assert real > 0.3 and gap(made) > 0.6 * real


def test_nearest_matrix():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    m = generate.nearest(bad)
    assert np.linalg.eigvalsh(m)[0] > 0 and np.allclose(np.diag(m), 1) and np.abs(m - bad).max() < 0.5
    good = np.array([[1, 0.3], [0.3, 1]])
    assert (generate.nearest(good) == good).all()


def test_bins_have_one_for_nulls(spark):
    train = spark.createDataFrame([(float(i), "a" if i % 3 else "b", 1.0) for i in range(100)] + [(None, None, 0.0)], "x double, c string, y double")
    e = utility.encoder(train, ["x"], ["c"], 4)
    test = spark.createDataFrame([(None, None, 1.0), (-5.0, " A ", 1.0), (50.0, "b", 0.0), (1e9, "zzz", 0.0), (float("nan"), "a", 1.0), (1.0, "a", None)], "x double, c string, y double")
    assert e.cuts["x"] == [24.75, 49.5, 74.25] and e.codes["c"] == ["a", "b"]
    assert [tuple(r) for r in utility.encoded(test, e, F.col("y")).collect()] == [(1.0, 0.0, 0.0), (1.0, 1.0, 2.0), (0.0, 3.0, 3.0), (0.0, 4.0, 1.0), (1.0, 0.0, 2.0)]
