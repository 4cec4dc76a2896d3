"""Profiles of the standard tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf, normal_cdf_sql, normal_inv, normal_inv_sql
from ..operators import infer, profile
from .catalogue import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM lineitem" for c in NUMBERS)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""SELECT "column", count(*)::BIGINT AS n_rows, (count(*) - count(value))::BIGINT AS n_null, count(DISTINCT value)::BIGINT AS n_distinct, min(value) AS min, max(value) AS max,
round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS stddev FROM ({_LONG}) GROUP BY 1""")
def profile_numeric_summary(spark, sf):
    return _rounded(profile.numeric_summary(table(spark, sf, "lineitem"), NUMBERS), 4, "mean", "median", "stddev")


@query("""SELECT 'o_totalprice' AS "column", unnest(range(0, 101))::INTEGER AS k, round(unnest(quantile_cont(o_totalprice, [x / 100e0 FOR x IN range(0, 101)])), 4) AS q FROM orders""")
def profile_quantiles_101(spark, sf):
    return _rounded(profile.quantiles(table(spark, sf, "orders"), ["o_totalprice"]).withColumn("k", F.col("k").cast("int")), 4, "q")


@query("""SELECT min(epoch_ms(o_orderdate))::BIGINT AS lo, max(epoch_ms(o_orderdate))::BIGINT AS hi, round(quantile_cont(epoch_ms(o_orderdate)::DOUBLE, 0.5), 0) AS mid FROM orders""")
def profile_datetime_summary(spark, sf):
    days = table(spark, sf, "orders").select(profile.numeric_view(F.col("o_orderdate"), "datetime").alias("day"))
    ends = profile.quantiles(days, ["day"], [0.0, 0.5, 1.0])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("q")))
    return ends.agg(at(0).cast("long").alias("lo"), at(2).cast("long").alias("hi"), F.round(at(1), 0).alias("mid"))


@query("""SELECT 'text' AS "column", round(avg(length(text)), 4) AS avg_length, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length FROM documents""")
def profile_text_lengths(spark, sf):
    out = profile.text_lengths(table(spark, sf, "documents"), ["text"])
    return out.select("column", F.round("avg_length", 4).alias("avg_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query("""WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY "column") AS t FROM c)
SELECT "column", rank::INTEGER AS rank, value, n::BIGINT AS n, round(100e0 * n / t, 6) AS pct FROM r WHERE rank <= 20""")
def profile_top_values(spark, sf):
    return _rounded(profile.top_values(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], 20), 6, "pct")


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in _PAIRS))
def pearson_pairs(spark, sf):
    return _rounded(profile.correlations(table(spark, sf, "lineitem"), NUMBERS), 4, "r")


@query(f"""WITH c AS (SELECT c_acctbal AS value, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS m FROM c),
p AS (SELECT value, n, (upto - n + (n - 1) / 2e0 + 0.5e0) / m AS p FROM r) SELECT value, n::BIGINT AS n, round({normal_inv_sql("p")}, 5) AS z FROM p""")
def latent_numeric_scores(spark, sf):
    return _rounded(profile.normal_scores(table(spark, sf, "customer"), "c_acctbal"), 5, "z")


_PDF = lambda p: f"coalesce(exp(-({normal_inv_sql(p)}) * ({normal_inv_sql(p)}) / 2e0) / sqrt(2e0 * pi()), 0e0)"


@query(f"""WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT value, n, sum(n) OVER (ORDER BY n DESC, value) / (sum(n) OVER ())::DOUBLE AS hi, n / (sum(n) OVER ())::DOUBLE AS w FROM c),
e AS (SELECT value, n, w, CASE WHEN hi - w < 1e-12 THEN 0e0 ELSE hi - w END AS lo, CASE WHEN hi > 1 - 1e-12 THEN 1e0 ELSE hi END AS hi FROM s)
SELECT value, n::BIGINT AS n, round(({_PDF("lo")} - {_PDF("hi")}) / w, 5) AS score FROM e""")
def latent_category_scores(spark, sf):
    return _rounded(profile.category_scores(table(spark, sf, "orders"), "o_orderpriority"), 5, "score")


@query(f"""WITH v AS ({_LONG}), q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1)
SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, sum((q3 > q1 AND (value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)))::INT)::BIGINT AS n_outliers FROM v JOIN q USING ("column") GROUP BY "column", q.q1, q.q3""")
def tukey_outliers(spark, sf):
    return _rounded(profile.outliers(table(spark, sf, "lineitem"), NUMBERS), 4, "q1", "q3")


@query("""WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS a3, quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.75) AS b3 FROM lineitem)
SELECT count(*)::BIGINT AS n_rows, (count(*) * 4)::BIGINT AS n_cells, sum((l_orderkey IS NULL)::INT + (x IS NULL)::INT + (l_quantity IS NULL)::INT + (l_extendedprice IS NULL)::INT)::BIGINT AS n_missing,
round(sum((l_orderkey IS NULL)::INT + (x IS NULL)::INT + (l_quantity IS NULL)::INT + (l_extendedprice IS NULL)::INT) / (count(*) * 4e0), 9) AS missing_rate,
sum((l_quantity < a1 - 1.5e0 * (a3 - a1) OR l_quantity > a3 + 1.5e0 * (a3 - a1))::INT + (l_extendedprice < b1 - 1.5e0 * (b3 - b1) OR l_extendedprice > b3 + 1.5e0 * (b3 - b1))::INT)::BIGINT AS n_outliers
FROM (SELECT *, CASE WHEN l_linenumber > 2 THEN l_linestatus END AS x FROM lineitem), q""")
def dataset_totals(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("x"), "l_quantity", "l_extendedprice")
    return _rounded(profile.totals(t, ["l_quantity", "l_extendedprice"]), 9, "missing_rate")


@query("""SELECT (CASE WHEN l_extendedprice < 1000 THEN -1 WHEN l_extendedprice > 90000 THEN 20 ELSE least(19, floor((l_extendedprice - 1000e0) / (89000e0 / 20))) END)::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def histogram_20(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 1000.0, 90000.0)


@query(f"SELECT p_partkey, round({normal_cdf_sql('((p_size - 25) / 10e0)')}, 9) AS p, round({normal_inv_sql('(p_size / 51e0)')}, 6) AS z FROM part")
def normal_grids(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(normal_cdf((size - 25) / 10.0), 9).alias("p"), F.round(normal_inv(size / 51.0), 6).alias("z"))


_FACT_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
_FACT_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM (SELECT o_orderkey::VARCHAR AS o_orderkey, round(o_totalprice, 0)::BIGINT::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus FROM orders)" for c in _FACT_COLUMNS)


@query(f"""SELECT "column", count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_distinct, avg(regexp_matches(v, '^[+-]?[0-9]+$')::INT)::DOUBLE AS number, avg(regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')::INT)::DOUBLE AS date,
round(avg(length(v)), 4) AS avg_length FROM ({_FACT_LONG}) GROUP BY 1""")
def infer_type_shares(spark, sf):
    o = table(spark, sf, "orders")
    text = o.select(F.col("o_orderkey").cast("string"), F.round("o_totalprice", 0).cast("long").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderstatus")
    return infer.type_shares(text, _FACT_COLUMNS).select("column", "n", "n_distinct", "number", "date", F.round("avg_length", 4).alias("avg_length"))


@query()
def infer_schema(spark, sf):
    """Specs of all columns of customer and orders read as text."""
    specs = []
    for name in ("customer", "orders"):
        t = table(spark, sf, name)
        text = t.select(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if k.startswith("timestamp") else F.col(c).cast("string")).alias(c) for c, k in t.dtypes])
        specs += [(name, s.name, s.type, s.semantic, s.kind, s.nullable, s.unique, s.privacy) for s in infer.infer(text)]
    return spark.createDataFrame(specs, "tbl string, name string, type string, semantic string, kind string, nullable boolean, is_unique boolean, privacy string")


@query("""SELECT count(*)::BIGINT AS n_runs, count(DISTINCT user_id)::BIGINT AS n_fingerprints, round(sum(value), 2) AS total, sum((ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)::INT)::BIGINT AS n_recent FROM events""")
def dashboard_counts(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).agg(F.count("*").alias("n_runs"), F.count_distinct("user_id").alias("n_fingerprints"), F.round(F.sum("value"), 2).alias("total"), F.sum((F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).cast("long")).alias("n_recent"))


@query("SELECT user_id, count(*)::BIGINT AS n, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def runs_by_fingerprint(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*)::BIGINT AS n FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    return reduce(DataFrame.unionAll, [table(spark, sf, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in TABLES])
