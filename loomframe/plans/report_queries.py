"""Exports of linked tables, statement and invoice reports, column status, generated keys, and regression between real and synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import documents, generate, quality, utility
from ..sources import writers
from .catalogue import query, table


@query("""SELECT 0 AS position, 'region' AS "table", '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region
UNION ALL SELECT 1, 'nation', '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation""")
def relational_json(spark, sf):
    return writers.relational_json({"region": table(spark, sf, "region").select("r_regionkey", "r_name"), "nation": table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")})


_SIZE = "greatest(16, pow(2, ceil(log2((SELECT max(length({c})) FROM {t}))))::INT)"


@query(f"""SELECT 'region' AS "table", 'CREATE TABLE "region" (' || chr(10) || '  "r_regionkey" BIGINT NOT NULL,' || chr(10) || '  "r_name" VARCHAR(' || {_SIZE.format(c="r_name", t="region")} || ') NOT NULL,' || chr(10) || '  PRIMARY KEY ("r_regionkey"),' || chr(10) || '  UNIQUE ("r_name")' || chr(10) || ');' AS statement
UNION ALL SELECT 'nation', 'CREATE TABLE "nation" (' || chr(10) || '  "n_nationkey" BIGINT NOT NULL,' || chr(10) || '  "n_name" VARCHAR(' || {_SIZE.format(c="n_name", t="nation")} || ') NOT NULL,' || chr(10) || '  "n_regionkey" BIGINT NOT NULL,' || chr(10) || '  PRIMARY KEY ("n_nationkey"),' || chr(10) || '  FOREIGN KEY ("n_regionkey") REFERENCES "region" ("r_regionkey")' || chr(10) || ');'""")
def sql_create_tables(spark, sf):
    region, nation = table(spark, sf, "region").select("r_regionkey", "r_name"), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return writers.sql_create(region, "region", "r_regionkey", unique=("r_name",)).unionByName(writers.sql_create(nation, "nation", "n_nationkey", {"n_regionkey": ("region", "r_regionkey")}))


@query("""SELECT 'a' AS "column", 'NUMERIC(20,' || greatest(2, (SELECT max(length(rtrim(split_part(abs(round(o_totalprice / 7, 4))::DECIMAL(38,6)::VARCHAR, '.', 2), '0'))) FROM orders)) || ')' AS sql_type, true AS not_null
UNION ALL SELECT 'b', 'CHAR(36)', true UNION ALL SELECT 'c', 'TEXT', (SELECT count(*) = 0 FROM orders WHERE o_orderstatus = 'F')""")
def sql_type_by_values(spark, sf):
    """Scales up to six, identifiers in the form of UUIDs, and long texts with nulls."""
    u = F.regexp_replace(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return writers.sql_columns(table(spark, sf, "orders").select(F.round(F.col("o_totalprice") / 7, 4).alias("a"), u.alias("b"), F.when(F.col("o_orderstatus") != "F", F.repeat("o_orderstatus", 1001)).alias("c")))


@query("""SELECT user_id, count(*)::BIGINT AS n, sum((NOT ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')::INT)::BIGINT AS n_outside, sum((abs(c) < 100 OR abs(c) > 5000)::INT)::BIGINT AS n_amount, sum((b < 0)::INT)::BIGINT AS n_under, false AS closing_off, count(*) NOT BETWEEN 5 AND 40 AS count_off
FROM (SELECT *, 1000 + sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * round(value * 100)::BIGINT AS c FROM events)) GROUP BY user_id""")
def statement_limits(spark, sf):
    cents = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * F.round(F.col("value") * 100).cast("long")
    rows = documents.floor_fold(table(spark, sf, "events").select("user_id", "ts", "event_id", cents.alias("cents")), "user_id", ["ts", "event_id"], "cents", 1000, -(10**15))
    dated = rows.withColumn("day", F.to_date("ts"))
    return documents.check_statement_limits(dated, "user_id", "day", ["ts", "event_id"], "cents", "balance", 1000, 0, ("2024-01-05", "2024-01-25"), 100, 5000, (5, 40))


_INVOICE = "SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total, sum(round(l_extendedprice * 17)::BIGINT)::BIGINT AS tax, count(*)::BIGINT AS n FROM lineitem GROUP BY 1"


def _order_invoices(spark, sf) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(price * 100).cast("long")).alias("total"), F.sum(F.round(price * 17).cast("long")).alias("tax"), F.count("*").alias("n"))


@query(f"SELECT count(*)::BIGINT AS n, sum(total)::BIGINT AS total, round(avg(total), 4) AS mean, sum(tax)::BIGINT AS tax, sum(n)::BIGINT AS n_lines FROM ({_INVOICE})")
def invoice_stats(spark, sf):
    return documents.invoice_stats(_order_invoices(spark, sf), "total", "tax", "n").withColumn("mean", F.round("mean", 4))


@query(f"SELECT k::BIGINT AS n_lines, (SELECT count(*) FROM ({_INVOICE}) i WHERE i.n = k)::BIGINT AS n FROM range(1, 9) r(k)")
def invoices_by_lines(spark, sf):
    return documents.by_line_count(_order_invoices(spark, sf), "n")


_METRICS = "SELECT l_returnflag AS c, avg(l_tax) AS t, max(l_linenumber) AS m, avg(l_discount) AS d FROM lineitem GROUP BY 1"


@query(f"""WITH m AS ({_METRICS}) SELECT c AS "column", CASE WHEN c = 'A' THEN 'issue' WHEN 5 * d > 0.2 OR abs(t) > 0.05 THEN 'warning' ELSE 'ok' END AS status FROM m""")
def column_status(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("column")).agg(F.avg("l_tax").alias("null_gap"), (5 * F.avg("l_discount")).alias("ks_d"))
    return quality.column_status(m.withColumns({"tvd": F.lit(None).cast("double"), "leaked": F.lit(0), "unique_extra": F.when(F.col("column") == "A", 1).otherwise(0)}))


@query("""WITH p AS (SELECT o_orderkey, round(o_totalprice, 0) AS s FROM orders), v AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS v FROM lineitem GROUP BY 1),
t AS (SELECT 100 * (1 - sum((abs(s - v) > 1)::INT) / count(*)) AS x FROM p JOIN v ON o_orderkey = l_orderkey), d AS (SELECT 100 * (1 - sum((n > 4)::INT) / count(*)) AS y FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)),
s AS (SELECT floor(x * 10 + 0.5) / 10 AS x, floor(y * 10 + 0.5) / 10 AS y FROM t, d)
SELECT 'cross_table' AS dimension, x AS score FROM s UNION ALL SELECT 'documents', y FROM s UNION ALL SELECT 'overall', floor((x + y) / 2 * 10 + 0.5) / 10 FROM s""")
def quality_totals_and_documents(spark, sf):
    """How many order totals follow their items, and how many orders have no more than four."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    found = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(net)).alias("v"), F.count("*").alias("k"))
    totals = table(spark, sf, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count("*").alias("n_parents"), F.sum((F.abs(F.round("o_totalprice") - F.col("v")) > 1).cast("long")).alias("n_off"))
    counted = found.agg(F.count("*").alias("n"), F.sum((F.col("k") > 4).cast("long")).alias("n_bad"))
    none = table(spark, sf, "region").select(*[F.lit(None).cast("double").alias(c) for c in ("ks_d", "tvd", "null_gap", "unique_extra", "leaked")])
    return quality.dimensions(none, totals=totals, documents=counted).where("dimension IN ('cross_table', 'documents', 'overall')")


_d = lambda stream, k, n: f"floor({rng.uniform_sql(42, stream, 'p_partkey', k)} * {n})::INT"
_ABC = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {} + 1, 1)"


@query(f"""SELECT p_partkey, {" || ".join([_ABC.format(_d("passport", k, 26)) for k in (0, 1)] + [_d("passport", k, 10) + "::VARCHAR" for k in range(2, 9)])} AS passport,
'ORD-' || CASE WHEN p_partkey + 9998 < 10000 THEN lpad((p_partkey + 9998)::VARCHAR, 4, '0') ELSE (p_partkey + 9998)::VARCHAR END || 'x' AS k,
['red', 'green', 'blue'][{_d("pool", 0, 3)} + 1] AS pool, CASE WHEN {rng.uniform_sql(42, "edge:p_size", "p_partkey")} < 0.05 THEN [-1, 0, 2147483647][{_d("edge value:p_size", 0, 3)} + 1] ELSE p_size END::INT AS p_size
FROM part""")
def gen_keys_and_edges(spark, sf):
    """Sensitive numbers from templates, keys in the format of a sample, pool values and edge cases."""
    rid = F.col("p_partkey")
    made = generate.edge_cases(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size"), rid.alias("_rid")), "p_size", [-1, 0, 2147483647], 42, 0.05)
    return made.select("p_partkey", generate.fill_template(generate.template("passport_no"), 42, "passport", rid).alias("passport"), generate.string_key("ORD-9998x", rid).alias("k"), generate.from_pool(["red", "green", "blue"], 42, "pool", rid).alias("pool"), "p_size")


@query()
def forest_prices(spark, sf):
    """r2 and mae of line prices from quantities and flags, on rows left aside."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")
    train, test = utility.split(rows, "id", 7)
    return utility.regression(utility.forest_values(train, test, ["l_quantity"], ["l_returnflag", "l_linestatus"], "l_extendedprice", regression=True), "predicted", "label")
