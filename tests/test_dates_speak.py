"""Dates and columns of up to 30 categories are features, whatever can't be a target."""

from pyspark.sql import functions as F

from loomframe.functions import rng
from loomframe.operators import utility
from loomframe.operators.infer import ColumnSpec


def test_dates_and_categories_are_features(spark):
    u = lambda stream: rng.uniform(9, stream, F.col("id"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u("d") * 1000).cast("int"))
    rows = spark.range(800).select(
        "id", day.cast("timestamp").alias("at"), F.when(u("n") < 0.02, "soon").otherwise(F.date_format(day, "dd/MM/yyyy")).alias("told"), F.concat(F.lit("k"), F.floor(u("k") * 25).cast("string")).alias("kind"),
        F.concat(F.lit("m"), F.floor(u("m") * 60).cast("string")).alias("many"), F.when(F.floor(u("d") * 1000) < 600, "closed").otherwise("open").alias("state"),
    )
    specs = [
        ColumnSpec("id", "integer", "Identifier", "identifier", False, True), ColumnSpec("at", "datetime", "Date", "datetime"), ColumnSpec("told", "date", "Date", "datetime"), ColumnSpec("kind", "string", "Category", "categorical"),
        ColumnSpec("many", "string", "Category", "categorical"), ColumnSpec("state", "string", "Status", "categorical"),
    ]
    found = utility.tstr(rows, specs, "id", 5, "state")
    assert found.features == ("at", "told", "kind") and found.excluded == {"id": "identifies rows", "many": "too many classes"}
    assert found.real > 0.98 and found.utility > 0.75, found


def test_text_dates_are_read_in_their_order(spark):
    spec = [ColumnSpec("d", "string", "Date", "datetime"), ColumnSpec("x", "integer", "Other", "numeric")]
    rows = spark.createDataFrame([("03/04/2021", 1), ("25/12/2020", 2), (None, 3), ("never", 4)], "d string, x int")
    read, specs = utility._dated(rows, spec)
    assert [str(r.d)[:10] for r in read.orderBy("x").collect()] == ["2021-04-03", "2020-12-25", "None", "None"]
    assert [s.type for s in specs] == ["datetime", "integer"] and utility._dated(read, specs)[0] is read
