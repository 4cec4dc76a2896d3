"""What a report measures is worked out once, and typed cells and rates of 0 cost nothing."""

from datetime import date, datetime

from pyspark.sql import functions as F

from loomframe.operators import generate, quality, validate
from loomframe.operators.infer import ColumnSpec


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_are_measured_once(spark):
    n = F.sum("id").cast("double")
    checks = spark.range(7).agg(n.alias("measured")).select(F.lit("a").alias("check"), F.when(F.col("measured") > 3, "failed").otherwise("passed").alias("status"), "measured")
    found = validate.worst(checks)
    assert _plan(found).count("Range (0, 7") == 1
    assert list(map(tuple, found.select("check", "status", "measured").collect())) == [("a", "failed", 21.0), ("overall", "failed", None)]
    bare = validate.worst(checks.drop("measured").withColumn("more", F.lit(5)).limit(0))
    assert {(r.check, r.status, r.measured, r.more) for r in bare.collect()} == {("overall", "passed", None, None)}


def test_dimensions_are_measured_once(spark):
    metrics = spark.range(8).select(F.lit("c").alias("column"), (F.col("id") / 80).alias("ks_d"), *[F.lit(None).cast("double").alias(c) for c in ("tvd", "null_gap", "unique_extra", "leaked")])
    found = quality.dimensions(metrics, spark.createDataFrame([(0.5,)], "drift double"))
    assert _plan(found).count("Range (0, 8") == 1
    assert {r.dimension: r.score for r in found.collect()} == {"fidelity": 95.6, "correlation": 50.0, "uniqueness": None, "null_distribution": None, "privacy": None, "overall": 72.8}


def test_typed_cells_are_judged_as_their_texts(spark):
    days = [date(2024, 2, 29), date(1, 1, 1), None]
    rows = [(x, k, d, t) for x in (1.0, -2.5, 1e300, 1e-7, -0.0, float("nan"), float("inf"), float("-inf"), None) for k in (3, None) for d in days for t in (datetime(2024, 1, 5, 7, 8, 9, 120), None)]
    # A year of five digits is none that a date is read from.
    df = spark.createDataFrame(rows, "x double, k long, d date, t timestamp").union(spark.sql("SELECT 1D, 1L, DATE '+12024-01-01', TIMESTAMP '-0001-01-01 00:00:00'"))
    for kinds in ({"x": "float", "k": "integer", "d": "date", "t": "datetime"}, {"x": "integer", "k": "float", "d": "datetime", "t": "date"}):
        typed = validate.type_validity(df, kinds)
        assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, validate.type_validity(df.select([F.col(c).cast("string") for c in df.columns]), kinds).collect()))
        assert "RLIKE" not in _plan(typed) and "make_timestamp" not in _plan(typed)


def test_rates_of_zero_draw_nothing(spark):
    specs = [ColumnSpec("x", "float", "Currency", "numeric"), ColumnSpec("d", "datetime", "Date", "datetime"), ColumnSpec("c", "string", "Category", "categorical"), ColumnSpec("t", "string", "Description", "text")]
    learnt = generate.Profile({"x": generate.ColumnProfile("numeric", [0.0, 9.0]), "d": generate.ColumnProfile("numeric", [0.0, 9e9]), "c": generate.ColumnProfile("category", values=list("abcd"), counts=[4, 3, 2, 1])}, [], None)
    cells = spark.range(5).select(F.col("id").alias("_rid"), F.col("id").cast("double").alias("x"), F.timestamp_seconds("id").alias("d"), F.lit("a").alias("c"), F.lit("b").alias("t"))
    own = lambda **rates: generate.inject(cells, specs, 1, learnt, generate.Config(edges={"t": ("z",)}, **rates))
    assert "md5" not in _plan(own(edge_rate=0.0)) and own(edge_rate=0.0).drop(*[f"_f_{s.name}" for s in specs]).exceptAll(cells).isEmpty()
    assert own(edge_rate=0.0).where("_f_x + _f_d + _f_c + _f_t > 0").isEmpty()
    full = own(null_rate=1.0, edge_rate=1.0).first()
    assert (full.x, full.d, full.c, full.t, full._f_x, full._f_t) == (None, None, None, None, 1, 1) and own(edge_rate=1.0).first().t == "z"
