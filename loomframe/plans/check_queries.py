"""Rules, links between tables, validation and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import documents, quality, relational, rules, utility, validate
from ..operators.infer import ColumnSpec
from ..operators.rules import Rule
from .catalogue import query, table

_RULES = [Rule("range", "l_quantity", low=5, high=45), Rule("allowed", "l_returnflag", values=("A", "N")), Rule("pattern", "l_linestatus", pattern="[FO]"), Rule("compare", "l_discount", op="<=", other="l_tax")]


@query("""SELECT count(*)::BIGINT AS n_rows, sum((NOT a)::INT)::BIGINT AS v0, sum((NOT b)::INT)::BIGINT AS v1, sum((NOT c)::INT)::BIGINT AS v2, sum((NOT d)::INT)::BIGINT AS v3, sum((a AND b AND c AND d)::INT)::BIGINT AS n_passing
FROM (SELECT l_quantity BETWEEN 5 AND 45 AS a, l_returnflag IN ('A', 'N') AS b, regexp_full_match(l_linestatus, '[FO]') AS c, l_discount <= l_tax AS d FROM lineitem)""")
def rules_check(spark, sf):
    return rules.check(table(spark, sf, "lineitem"), _RULES)


_RANGE_U = rng.uniform_sql(3, "rule0", "o_orderkey")


@query(f"SELECT o_orderkey, round(CASE WHEN o_totalprice BETWEEN 20000 AND 100000 THEN o_totalprice ELSE {_RANGE_U} * 80000e0 + 20000e0 END, 4) AS o_totalprice FROM orders")
def rules_enforce_range(spark, sf):
    out = rules.enforce(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [Rule("range", "o_totalprice", low=20000.0, high=100000.0)], "o_orderkey", seed=3, passes=1)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus WHEN {_RANGE_U} < 0.5 THEN 'F' ELSE 'O' END AS o_orderstatus FROM orders")
def rules_enforce_allowed(spark, sf):
    return rules.enforce(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [Rule("allowed", "o_orderstatus", values=("F", "O"))], "o_orderkey", seed=3, passes=1)


@query("SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS l_discount, greatest(l_discount, l_tax) AS l_tax FROM lineitem")
def rules_enforce_compare(spark, sf):
    out = rules.enforce(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), [Rule("compare", "l_discount", op="<=", other="l_tax")], "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


_CHILDREN = {"orders.o_custkey": ("orders", "o_custkey"), "lineitem.l_orderkey": ("lineitem", "l_orderkey"), "lineitem.l_suppkey": ("lineitem", "l_suppkey"), "customer.c_nationkey": ("customer", "c_nationkey")}
_PARENTS = {"customer.c_custkey": ("customer", "c_custkey"), "orders.o_orderkey": ("orders", "o_orderkey"), "supplier.s_suppkey": ("supplier", "s_suppkey"), "nation.n_nationkey": ("nation", "n_nationkey")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS child, '{p}' AS parent, count(*)::BIGINT AS n_values, sum((v NOT IN (SELECT {pc} FROM {pt}))::INT)::BIGINT AS n_missing FROM (SELECT DISTINCT {cc} AS v FROM {ct})" for c, (ct, cc) in _CHILDREN.items() for p, (pt, pc) in _PARENTS.items()))
def fk_containment(spark, sf):
    side = lambda m: {n: (table(spark, sf, t), c) for n, (t, c) in m.items()}
    return relational.inclusions(side(_CHILDREN), side(_PARENTS))


@query("SELECT count(*)::BIGINT AS n_parents, sum((n = 0)::INT)::BIGINT AS n_childless, min(n)::BIGINT AS min_children, max(n)::BIGINT AS max_children FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def fk_children_stats(spark, sf):
    return relational.children_stats(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT count(k)::BIGINT AS n_fk, (count(*) - count(k))::BIGINT AS n_null, sum((k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3))::INT)::BIGINT AS n_orphans FROM (SELECT nullif(o_custkey, 7) AS k FROM orders)")
def ri_orphans(spark, sf):
    child = table(spark, sf, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("k"))
    return relational.orphans(child, "k", table(spark, sf, "customer").where("c_custkey % 10 <> 3"), "c_custkey")


@query("SELECT sum(c - 1)::BIGINT AS n_extra FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey)")
def join_pair_duplicates(spark, sf):
    return relational.pair_duplicates(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


_HOWS = ("sum", "avg", "min", "max", "count")


@query("SELECT o_orderkey, " + ", ".join(f"floor({'coalesce(' if h in ('sum', 'count') else ''}{h}(l_quantity * l_discount){', 0)' if h in ('sum', 'count') else ''} * 10e0 + 0.5e0 + 1e-9) / 10e0 AS v_{h}" for h in _HOWS) + " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rule_aggregates(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    term = F.col("l_quantity") * F.col("l_discount") + F.lit(0.0)
    found = [relational.rule_values(orders, "o_orderkey", lines, "l_orderkey", term, h, 6).select("o_orderkey", (F.floor(F.col("value") * 10.0 + 0.5 + 1e-9) / 10.0).alias(f"v_{h}")) for h in _HOWS]
    return reduce(lambda a, b: a.join(b, "o_orderkey"), found)


@query("SELECT count(*)::BIGINT AS n_parents, sum((abs(o_totalprice - coalesce(v, 0)) > 0.01 + 1e-9 * abs(coalesce(v, 0)))::INT)::BIGINT AS n_off FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def rule_reconcile(spark, sf):
    orders = table(spark, sf, "orders")
    return relational.reconcile(orders, "o_orderkey", "o_totalprice", relational.rule_values(orders, "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", F.col("l_extendedprice"), "sum", 6))


_KS = """SELECT max(abs(a / n::DOUBLE - b / m::DOUBLE)) AS d FROM (SELECT v, sum(sum(x)) OVER (ORDER BY v) AS a, sum(sum(y)) OVER (ORDER BY v) AS b, sum(sum(x)) OVER () AS n, sum(sum(y)) OVER () AS m
FROM (SELECT {0} AS v, ({1})::INT AS x, ({2})::INT AS y FROM {3} WHERE ({1}) OR ({2})) GROUP BY v)"""


@query(f"SELECT round(d, 6) AS d FROM ({_KS.format('l_extendedprice', chr(39).join(['l_returnflag = ', 'A', '']), chr(39).join(['l_returnflag = ', 'R', '']), 'lineitem')})")
def ks_two_sample(spark, sf):
    t = table(spark, sf, "lineitem")
    return validate.ks_statistic(t.where("l_returnflag = 'A'"), t.where("l_returnflag = 'R'"), "l_extendedprice").select(F.round("d", 6).alias("d"))


@query("""WITH c AS (SELECT p_type AS v, sum((p_size <= 25)::INT) AS x, sum((p_size > 25)::INT) AS y FROM part GROUP BY 1) SELECT round(sum(abs(x / (SELECT sum(x) FROM c)::DOUBLE - y / (SELECT sum(y) FROM c)::DOUBLE)) / 2, 6) AS tvd, count(*)::BIGINT AS n_categories FROM c""")
def tvd_categories(spark, sf):
    t = table(spark, sf, "part")
    return validate.total_variation(t.where("p_size <= 25"), t.where("p_size > 25"), "p_type").withColumn("tvd", F.round("tvd", 6))


_DRIFT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) FILTER (l_orderkey % 2 = 0) AS m1, avg({c}) FILTER (l_orderkey % 2 = 1) AS m2, stddev_samp({c}) FILTER (l_orderkey % 2 = 0) AS d1, stddev_samp({c}) FILTER (l_orderkey % 2 = 1) AS d2 FROM lineitem" for c in ("l_quantity", "l_tax"))


@query(f"SELECT \"column\", round(greatest(abs(m2 - m1), abs(d2 - d1)) / greatest(abs(m1), d1), 6) AS drift, CASE WHEN greatest(abs(m2 - m1), abs(d2 - d1)) / greatest(abs(m1), d1) <= 0.1 THEN 'passed' ELSE 'failed' END AS status FROM ({_DRIFT})")
def moment_drift(spark, sf):
    t = table(spark, sf, "lineitem")
    return validate.moment_drift(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), ["l_quantity", "l_tax"]).withColumn("drift", F.round("drift", 6))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(r1, 5) AS r1, round(r2, 5) AS r2, round(abs(r1 - r2), 5) AS drift FROM (SELECT corr(l_quantity, l_extendedprice) FILTER (l_orderkey % 2 = 0) AS r1, corr(l_quantity, l_extendedprice) FILTER (l_orderkey % 2 = 1) AS r2 FROM lineitem)""")
def corr_drift(spark, sf):
    t = table(spark, sf, "lineitem")
    out = validate.correlation_drift(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice"])
    return out.select("a", "b", *[F.round(c, 5).alias(c) for c in ("r1", "r2", "drift")])


@query("SELECT count(*)::BIGINT AS n_rows, sum((event_id % 7 = 0)::INT)::BIGINT AS n_copied FROM events")
def copied_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return validate.copied_rows(e, e.where("event_id % 7 = 0"), e.columns)


@query("SELECT 'name' AS \"column\", count(*)::BIGINT AS n_values, sum((lower(trim(s_name)) IN (SELECT lower(trim(s_name)) FROM supplier WHERE s_nationkey < 5))::INT)::BIGINT AS n_leaked FROM supplier")
def pii_leak(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_name", "name")
    return validate.leaks(s.withColumn("name", F.upper(F.concat(F.lit(" "), "name"))), s.where("s_nationkey < 5"), ["name"])


@query("SELECT 'x' AS \"column\", avg((o_orderkey % 20 = 0)::INT)::DOUBLE AS rate, 'passed' AS status FROM orders")
def null_rate_check(spark, sf):
    return validate.null_rates(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderkey")).alias("x")), ["x"], 0.05)


@query("SELECT 'l_orderkey' AS \"column\", (count(l_orderkey) - count(DISTINCT l_orderkey))::BIGINT AS n_extra FROM lineitem UNION ALL SELECT 'l_suppkey', (count(l_suppkey) - count(DISTINCT l_suppkey))::BIGINT FROM lineitem")
def uniqueness_check(spark, sf):
    return validate.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN -round(value * 100)::BIGINT ELSE round(value * 100)::BIGINT END AS cents FROM events) SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS running_balance, false AS out_of_order FROM e""")
def statement_running_balance(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", cents.alias("cents"))
    bought = F.col("event_type") == "purchase"
    out = validate.statement_check(e, "user_id", ["ts", "event_id"], F.when(bought, 0).otherwise(F.col("cents")), F.when(bought, F.col("cents")).otherwise(0))
    return out.select("event_id", "running_balance", "out_of_order")


_MOVES = "SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * round(value * 100)::BIGINT AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"


@query(f"""WITH RECURSIVE r AS ({_MOVES}), f AS (SELECT user_id, ts, event_id, k, greatest(1000 + c, 500) - 1000 AS cents, greatest(1000 + c, 500)::BIGINT AS balance FROM r WHERE k = 1
UNION ALL SELECT r.user_id, r.ts, r.event_id, r.k, greatest(f.balance + r.c, 500) - f.balance, greatest(f.balance + r.c, 500)::BIGINT FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, ts, event_id, cents::BIGINT AS cents, balance FROM f""")
def statement_floor_fold(spark, sf):
    cents = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * F.round(F.col("value") * 100).cast("long")
    return documents.floor_fold(table(spark, sf, "events").select("user_id", "ts", "event_id", cents.alias("cents")), "user_id", ["ts", "event_id"], "cents", 1000, 500)


_NEXT = "CASE WHEN r.c >= 0 OR {b} + r.c >= 500 THEN {b} + r.c WHEN {b} > 500 THEN 500 ELSE {b} + 2500 END"


@query(f"""WITH RECURSIVE r AS ({_MOVES}), f AS (SELECT user_id, event_id, k, 1000 AS before, ({_NEXT.format(b='1000')})::BIGINT AS balance FROM r WHERE k = 1
UNION ALL SELECT r.user_id, r.event_id, r.k, f.balance, ({_NEXT.format(b='f.balance')})::BIGINT FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, event_id, (balance - before)::BIGINT AS moved, balance FROM f""")
def statement_floor_refilled(spark, sf):
    """The same where an account without room gets a transfer of 2500 cents instead."""
    cents = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * F.round(F.col("value") * 100).cast("long")
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", cents.alias("cents"), F.lit(2500).cast("long").alias("refill"))
    return documents.floor_fold_refilled(rows, "user_id", ["ts", "event_id"], "cents", "refill", 1000, 500).select("user_id", "event_id", "moved", "balance")


@query("""SELECT l_orderkey, sum(round(l_quantity)::BIGINT * 100)::BIGINT AS subtotal_cents, floor(sum(round(l_quantity)::BIGINT * 100) * 17e0 / 100 + 0.5)::BIGINT AS tax_cents, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1""")
def invoice_reconcile(spark, sf):
    cents = F.round("l_quantity").cast("long") * 100
    found = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("subtotal_cents"), F.count("*").alias("n_lines"))
    return found.select("l_orderkey", "subtotal_cents", F.floor(F.col("subtotal_cents") * 17.0 / 100 + 0.5).cast("long").alias("tax_cents"), "n_lines")


_LINKED = (("orders", "o_custkey", "customer", "c_custkey", 1, 20), ("lineitem", "l_orderkey", "orders", "o_orderkey", 1, 4), ("customer", "c_nationkey", "nation", "n_nationkey", None, None))


def _link_sql(child: str, fk: str, parent: str, key: str, low: int | None, high: int | None) -> str:
    over = f"count(*) FILTER (here AND n > {high})" if high is not None else "0"
    return f"""SELECT '{child}.{fk} -> {parent}.{key}' AS link, sum(n) FILTER (k IS NOT NULL)::BIGINT AS n_fk, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS n_null, coalesce(sum(n) FILTER (k IS NOT NULL AND NOT here), 0)::BIGINT AS n_orphans,
count(*) FILTER (here AND n = 0)::BIGINT AS n_childless, min(n) FILTER (here)::BIGINT AS min_children, max(n) FILTER (here)::BIGINT AS max_children, count(*) FILTER (here AND n < {low or 0})::BIGINT AS n_under, {over}::BIGINT AS n_over
FROM (SELECT coalesce(c.k, p.k) AS k, coalesce(c.n, 0) AS n, p.k IS NOT NULL AS here FROM (SELECT {fk} AS k, count(*) AS n FROM {child} GROUP BY 1) c FULL JOIN (SELECT DISTINCT {key} AS k FROM {parent} WHERE {key} IS NOT NULL) p ON c.k = p.k)"""


@query(f"""SELECT *, CASE WHEN n_orphans > 0 THEN 'failed' WHEN n_under + n_over + n_null > 0 THEN 'warning' ELSE 'passed' END AS status, floor(1000e0 * (n_fk - n_orphans) / (n_fk + n_null) + 0.5::DOUBLE) / 10 AS integrity
FROM ({' UNION ALL '.join(_link_sql(*x) for x in _LINKED)})""")
def link_report(spark, sf):
    """Orders' customers (1 to 20 orders each), items' orders (1 to 4 items each) and customers' nations, checked."""
    names = {t for child, _, parent, *_ in _LINKED for t in (child, parent)}
    links = [relational.Relationship(parent, key, child, fk, low, high) for child, fk, parent, key, low, high in _LINKED]
    return relational.link_report({t: table(spark, sf, t) for t in names}, links)


_GAPS = (("orders", "o_totalprice", "CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_totalprice END"), ("customer", "c_acctbal", "c_acctbal"))


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS \"column\", round(avg(({x} IS NULL)::INT) - avg(({c} IS NULL)::INT), 9)::DOUBLE AS null_gap, (count({c}) - count(DISTINCT {c}))::BIGINT AS unique_extra, CASE WHEN count({c}) > count(DISTINCT {c}) THEN 'issue' WHEN abs(avg(({x} IS NULL)::INT) - avg(({c} IS NULL)::INT)) > 0.05 THEN 'warning' ELSE 'ok' END AS status FROM {t}" for t, c, x in _GAPS))
def linked_quality(spark, sf):
    """One report over two tables: null gaps of a thinned copy against the table itself, and repeats, by `table.column`."""
    metrics = {}
    for t, c, x in _GAPS:
        real = table(spark, sf, t)
        gaps = validate.null_gaps(real.select(F.expr(x).alias(c)), real.select(c), [c]).select("column", "null_gap")
        metrics[t] = gaps.join(validate.uniqueness(real, [c]).withColumnRenamed("n_extra", "unique_extra"), "column")
    whole = quality.linked(metrics).withColumns({k: F.lit(None).cast("double") for k in ("ks_d", "tvd", "leaked")})
    return whole.join(quality.column_status(whole), "column").select("column", F.round("null_gap", 9).alias("null_gap"), "unique_extra", "status")


@query("""SELECT 'fidelity' AS dimension, 80.0::DOUBLE AS score UNION ALL SELECT 'uniqueness', 50.0 UNION ALL SELECT 'null_distribution', 80.0 UNION ALL SELECT 'privacy', NULL UNION ALL SELECT 'referential', round(100e0 * (count(*) - sum((o_custkey % 10 = 3)::INT)) / count(*), 1) FROM orders
UNION ALL SELECT 'overall', floor((80 + 50 + 80 + (SELECT round(100e0 * (count(*) - sum((o_custkey % 10 = 3)::INT)) / count(*), 1) FROM orders)) / 4 * 10 + 0.5) / 10""")
def quality_dimensions(spark, sf):
    metrics = spark.createDataFrame([("a", 0.1, None, 0.0, 0, None), ("b", None, 0.3, 0.2, 3, None)], "column string, ks_d double, tvd double, null_gap double, unique_extra long, leaked long")
    links = relational.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_custkey % 10 <> 3"), "c_custkey")
    return quality.dimensions(metrics, links=links)


@query("""WITH x AS (SELECT quality AS y, (n_chars % 97)::DOUBLE AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS k FROM x)
SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def metric_auc(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("quality", (F.col("n_chars") % 97).alias("s"))
    return utility.auc(x, "s", "quality").select(F.round("auc", 6).alias("auc"))


_CLASSES = "(SELECT o_orderstatus AS l, CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END AS p FROM orders)"


@query(f"SELECT round(avg((l = p)::INT), 6) AS accuracy, (SELECT round(avg(f), 6) FROM (SELECT 2e0 * sum((l = c AND p = c)::INT) / (sum((l = c)::INT) + sum((p = c)::INT)) AS f FROM {_CLASSES}, (SELECT DISTINCT o_orderstatus AS c FROM orders) GROUP BY c)) AS macro_f1 FROM {_CLASSES}")
def metric_classes(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("l"), F.when(F.col("o_totalprice") > 100000, "F").otherwise("O").alias("p"))
    return utility.accuracy(x, "p", "l").crossJoin(utility.macro_f1(x, "p", "l")).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT round(1 - sum(pow(l_extendedprice - 1500e0 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 5) AS r2, round(avg(abs(l_extendedprice - 1500e0 * l_quantity)), 3) AS mae FROM lineitem")
def metric_regression(spark, sf):
    x = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("p"))
    return utility.regression(x, "p", "l_extendedprice").select(F.round("r2", 5).alias("r2"), F.round("mae", 3).alias("mae"))


_SPLIT = rng.uniform_sql(5, "split", "o_orderkey")


@query(f"SELECT o_orderkey, {_SPLIT} < 0.75 AS train FROM orders")
def split_train_test(spark, sf):
    train, test = utility.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _linked(spark, sf):
    """Three tables with names as uploads have them, and what their columns are."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total"))
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    key, number = lambda n: ColumnSpec(n, "integer", "Identifier", "identifier", False, True), lambda n: ColumnSpec(n, "float", "Other", "numeric")
    specs = {"customers": [key("customer_id"), number("balance")], "orders": [key("id"), ColumnSpec("customer_id", "integer", "Identifier", "identifier"), number("total")], "items": [ColumnSpec("order_id", "integer", "Identifier", "identifier"), number("line"), number("quantity")]}
    return {"customers": c, "orders": o, "items": i}, specs


def _fk_sql(parent: str, key: str, child: str, fk: str, names: str) -> str:
    return f"""SELECT {names}, CASE WHEN max(n) <= 1 THEN '1:1' ELSE '1:N' END AS cardinality, min(n)::BIGINT AS min_children, max(n)::BIGINT AS max_children
FROM (SELECT p.{key}, count(c.{fk}) AS n FROM {parent} p LEFT JOIN {child} c ON p.{key} = c.{fk} GROUP BY 1) WHERE NOT EXISTS (SELECT 1 FROM {child} WHERE {fk} NOT IN (SELECT {key} FROM {parent}))"""


@query(_fk_sql("customer", "c_custkey", "orders", "o_custkey", "'customers' AS parent, 'customer_id' AS parent_column, 'orders' AS child, 'customer_id' AS child_column")
       + " UNION ALL " + _fk_sql("orders", "o_orderkey", "lineitem", "l_orderkey", "'orders' AS parent, 'id' AS parent_column, 'items' AS child, 'order_id' AS child_column"))
def fk_detect(spark, sf):
    """Foreign keys found from unique parents, containment and names; ids that happen to lie within another table's are not preferred to named ones."""
    found = relational.detect(*_linked(spark, sf))
    rows = [(x.parent, x.parent_column, x.child, x.child_column, x.cardinality, x.low, x.high) for x in found if x.low is not None]
    return spark.createDataFrame(rows, "parent string, parent_column string, child string, child_column string, cardinality string, min_children long, max_children long")


_PARENT_U = rng.uniform_sql(42, "parent:nation", "c_custkey")


@query(f"""WITH p AS (SELECT n_nationkey AS fk, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation), c AS (SELECT c_custkey, {_PARENT_U} AS u FROM customer)
SELECT c_custkey, fk AS nation_id FROM c JOIN p ON i = least(floor(u * n), n - 1)""")
def rel_fk_uniform(spark, sf):
    return relational.random_parents(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "nation_id", table(spark, sf, "nation"), "n_nationkey", 42, "nation")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, floor(coalesce(sum(l_quantity * 2), 0) * 100 + 0.5) / 100e0 AS t FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT c_custkey AS customer_id, floor(coalesce(sum(t), 0) * 100 + 0.5) / 100e0 AS spent FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1""")
def rel_chained_totals(spark, sf):
    """Orders sum their items, customers their orders, whatever order the totals are given in."""
    tables, _ = _linked(spark, sf)
    R, S = relational.Relationship, relational.Total
    totals = [S(R("customers", "customer_id", "orders", "customer_id"), "spent", "total"), S(R("orders", "id", "items", "order_id"), "total", "quantity * 2")]
    return relational.apply_totals(tables, totals)["customers"].select("customer_id", "spent")


@query("""SELECT 'n' AS "column", count(*)::BIGINT AS n_values, sum((o_orderkey % 7 = 0)::INT)::BIGINT AS n_invalid FROM orders UNION ALL SELECT 'd', count(*)::BIGINT, sum((o_orderkey % 5 = 0)::INT)::BIGINT FROM orders
UNION ALL SELECT 'e', count(*)::BIGINT, sum((o_orderkey % 3 = 0)::INT)::BIGINT FROM orders UNION ALL SELECT 's', count(*)::BIGINT, 0::BIGINT FROM orders""")
def type_validity(spark, sf):
    k = F.col("o_orderkey")
    cells = table(spark, sf, "orders").select(
        F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")).alias("n"), F.when(k % 5 == 0, "2024-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.concat(F.lit("p"), k.cast("string"), F.when(k % 3 == 0, "@nowhere").otherwise("@example.com")).alias("e"), F.col("o_orderstatus").alias("s"),
    )
    return validate.type_validity(cells, {"n": "integer", "d": "date", "e": "email", "s": "string"})


@query("""WITH c AS (SELECT count(*) AS n, sum((o_totalprice < 20000)::INT) AS broken FROM orders), r AS (SELECT 'row count' AS "check", 'passed' AS status, n::DOUBLE AS measured FROM c UNION ALL SELECT 'types', 'passed', 0 UNION ALL SELECT 'unique keys', 'passed', 0
UNION ALL SELECT 'business rules', CASE WHEN broken > 0 THEN 'failed' ELSE 'passed' END, broken::DOUBLE FROM c UNION ALL SELECT 'copied rows', 'failed', n::DOUBLE FROM c UNION ALL SELECT 'distributions', 'passed', 0 UNION ALL SELECT 'categories', 'passed', 0)
SELECT * FROM r UNION ALL SELECT 'overall', 'failed', NULL""")
def validation_report(spark, sf):
    """A table against itself: everything agrees, every row is a copy."""
    specs = [ColumnSpec("o_orderkey", "integer", "Identifier", "identifier", False, True), ColumnSpec("o_totalprice", "float", "Currency", "numeric"), ColumnSpec("o_orderstatus", "string", "Status", "categorical")]
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return validate.report(t, specs, t.count(), t, (Rule("range", "o_totalprice", low=20000.0),))
