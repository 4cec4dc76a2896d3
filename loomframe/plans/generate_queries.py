"""Generated rows: draws in SQL, linked tables, documents, and whole synthetic tables with their quality."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import permute, rng
from ..functions.stats import quantile_function
from ..operators import design, documents, generate, ledger, profile, quality, redraw, relational, rules, tabular, utility, validate
from ..operators.infer import ColumnSpec
from .catalogue import query, table

ORDERS = [
    ColumnSpec("o_orderkey", "integer", "Identifier", "identifier", False, True), ColumnSpec("o_totalprice", "float", "Currency", "numeric"), ColumnSpec("o_orderdate", "datetime", "Date", "datetime"),
    ColumnSpec("o_orderstatus", "string", "Status", "categorical"), ColumnSpec("o_orderpriority", "string", "Category", "categorical"),
]
_u = lambda stream, key="c_custkey", k=0, seed=42: rng.uniform_sql(seed, stream, key, k)


@query(f"SELECT c_custkey, {_u('a')} AS u, (1 + floor({_u('a')} * 6))::BIGINT AS die FROM customer")
def gen_uniform(spark, sf):
    u = rng.uniform(42, "a", F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", u.alias("u"), rng.integer(u, 1, 6).alias("die"))


@query(f"SELECT c_custkey, round(sqrt(-2e0 * ln(1e0 - {_u('n')})) * cos(2e0 * pi() * {_u('n', k=1)}), 6) AS z FROM customer")
def gen_normal(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.round(rng.normal(rng.uniform(42, "n", key), rng.uniform(42, "n", key, 1)), 6).alias("z"))


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice, [x / 100e0 FOR x IN range(0, 101)]) AS q FROM orders), u AS (SELECT c_custkey, {_u('q')} AS u FROM customer),
k AS (SELECT c_custkey, u, least(floor(u * 100), 99)::INT AS k FROM u) SELECT c_custkey, round(q[k + 1] + (u * 100 - k) * (q[k + 2] - q[k + 1]), 4) AS x FROM k, q""")
def gen_numeric_quantile(spark, sf):
    q = [r["q"] for r in profile.quantiles(table(spark, sf, "orders"), ["o_totalprice"]).orderBy("k").collect()]  # 101 numbers
    return table(spark, sf, "customer").select("c_custkey", F.round(quantile_function(rng.uniform(42, "q", F.col("c_custkey")), q), 4).alias("x"))


@query(f"""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT v, sum(n) OVER (ORDER BY n DESC, v) / (sum(n) OVER ())::DOUBLE AS hi FROM c), u AS (SELECT c_custkey, {_u('cat')} AS u FROM customer)
SELECT c_custkey, (SELECT arg_min(v, hi) FROM s WHERE s.hi > u.u) AS v FROM u""")
def gen_category(spark, sf):
    top = profile.top_values(table(spark, sf, "orders"), ["o_orderpriority"]).orderBy("rank").collect()  # a few categories
    return table(spark, sf, "customer").select("c_custkey", rng.weighted(rng.uniform(42, "cat", F.col("c_custkey")), [r["value"] for r in top], [r["n"] for r in top]).alias("v"))


@query(f"SELECT c_custkey AS fk, k AS _k FROM (SELECT c_custkey, unnest(range(0, (1 + floor({_u('children:t')} * 5))::BIGINT)) AS k FROM customer)")
def rel_children(spark, sf):
    out = relational.children_of(table(spark, sf, "customer"), "c_custkey", 1, 5, 42, "t")
    return out.select("fk", F.col("_k").cast("long").alias("_k"))


@query(f"SELECT c_custkey AS fk FROM customer ORDER BY {_u('one:t')}, c_custkey LIMIT 50")
def rel_one_to_one(spark, sf):
    return relational.one_to_one(table(spark, sf, "customer"), "c_custkey", 50, 42, "t")


_LINKS = f"SELECT c_custkey AS a, unnest(range(0, (1 + floor({_u('links:t')} * 4))::BIGINT)) AS k FROM customer"


@query(f"SELECT a, b FROM ({permute.permuted_sql(_LINKS, 'k', 100, 42, 'partner:t', 'a', 'b')})")
def rel_many_to_many(spark, sf):
    return relational.many_to_many(table(spark, sf, "customer"), "c_custkey", 100, 1, 4, 42, "t")


@query(f"SELECT p_partkey, place FROM ({permute.permuted_sql('SELECT p_partkey FROM part WHERE p_partkey BETWEEN 1 AND 197', 'p_partkey - 1', 197, 42, 'parts', None, 'place')})")
def rel_permutation(spark, sf):
    """The first parts in another order, a number of them that no grid fits."""
    rows = table(spark, sf, "part").where("p_partkey BETWEEN 1 AND 197")  # the length of the permutation, a constant of its SQL
    return rows.select("p_partkey", permute.permuted(F.col("p_partkey") - 1, 197, 42, "parts").alias("place"))


def _learnt(spark, sf):
    original = table(spark, sf, "orders")
    return original, generate.learn(original, ORDERS)


@query()
def generate_orders(spark, sf):
    """As many synthetic orders as there are real ones, with nulls and outliers."""
    original, learnt = _learnt(spark, sf)
    return generate.generate(spark, ORDERS, original.count(), 42, learnt, generate.Config(null_rate=0.02, outlier_rate=0.01))


@query()
def generate_orders_quality(spark, sf):
    """Learn orders, generate as many, and score how faithful the result is."""
    original, learnt = _learnt(spark, sf)
    made = generate.generate(spark, ORDERS, original.count(), 42, learnt).drop(*[f"_f_{s.name}" for s in ORDERS]).persist()  # five checks read it
    ks = [validate.ks_statistic(made.select(profile.numeric_view(F.col(c), k).alias(c)), original.select(profile.numeric_view(F.col(c), k).alias(c)), c).select(F.lit(c).alias("column"), F.col("d").alias("ks_d")) for c, k in (("o_totalprice", "float"), ("o_orderdate", "datetime"))]
    tvd = [validate.total_variation(made, original, c).select(F.lit(c).alias("column"), "tvd") for c in ("o_orderstatus", "o_orderpriority")]
    metrics = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*ks, *tvd])
    gaps = validate.null_gaps(made, original, [s.name for s in ORDERS]).select("column", "null_gap")
    metrics = metrics.join(gaps, "column", "left").withColumns({"leaked": F.lit(None).cast("long"), "unique_extra": F.lit(None).cast("long")}).unionByName(validate.uniqueness(made, ["o_orderkey"]).select("column", F.col("n_extra").alias("unique_extra")), allowMissingColumns=True)
    view = lambda d: d.select("o_totalprice", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("day"))
    return quality.dimensions(metrics, validate.correlation_drift(view(original), view(made), ["o_totalprice", "day"]))


_LEDGER = ledger.Plan("checking", date(2026, 1, 15), date(2026, 4, 30), 30, 60_000, 20_000, 10.0, 1500.0, 1.5)


def _ledger_sql(plan: ledger.Plan, seed: int, ids: str) -> str:
    """The plan's rows, and their balances by recursion."""
    u = lambda what: rng.uniform_sql(seed, what, "(s || ':' || q)")
    fixed, mix = ledger.fixed_rows(plan), [x for x in ledger.MIXES[plan.account] if not x.day]
    amount = lambda what, item: "({0} + floor({2} * ({1} - {0} + 1)))::BIGINT".format(*ledger.bounds(item, plan), u(what))
    total, so_far, steps = float(sum(x.weight for x in mix)), 0.0, []
    for x in mix[:-1]:
        so_far += x.weight
        steps.append(f"WHEN {u('category')} < {so_far / total!r}::DOUBLE THEN '{x.category}'")
    listed = ", ".join(f"{{'q': {k}, 'day': DATE '{at}', 'category': '{item.category}'}}" for k, (at, item) in enumerate(fixed))
    cents = " ".join(f"WHEN '{x.category}' THEN {x.sign} * {amount('amount', x)}" for x in ledger.MIXES[plan.account])
    credit = max((x for x in mix if x.sign > 0), key=lambda x: x.weight)
    least, room = round((plan.least or 0.01) * 100), f"(b - {plan.floor})"
    move = f"CASE WHEN c >= 0 OR b + c >= {plan.floor} THEN c WHEN {room} >= {least} THEN -{room} ELSE refill END"
    return f"""WITH RECURSIVE ids AS ({ids}),
raw AS (SELECT s, x.q AS q, x.day AS day, x.category AS category FROM (SELECT s, unnest([{listed}]) AS x FROM ids) UNION ALL SELECT s, unnest(range({len(fixed)}, {plan.rows})) AS q, NULL, NULL FROM ids),
named AS (SELECT s, q, coalesce(day, DATE '{plan.first}' + floor({u('day')} * {(plan.last - plan.first).days + 1})::INT) AS day, coalesce(category, CASE {' '.join(steps)} ELSE '{mix[-1].category}' END) AS category FROM raw),
priced AS (SELECT *, CASE category {cents} END AS c, {amount('refill', credit)} AS refill, row_number() OVER (PARTITION BY s ORDER BY day, q) AS k FROM named),
walk AS (SELECT s, 0::BIGINT AS k, NULL::BIGINT AS cents, {plan.opening}::BIGINT AS balance FROM ids
  UNION ALL SELECT s, k, m, b + m FROM (SELECT s, k, b, {move} AS m FROM (SELECT p.s, p.k, p.c, p.refill, w.balance AS b FROM walk w JOIN priced p ON p.s = w.s AND p.k = w.k + 1)))
SELECT s AS statement, q AS seq, day, CASE WHEN c < 0 AND cents > 0 THEN 'transfer in' ELSE category END AS category, cents, balance FROM priced JOIN walk USING (s, k)"""


@query(_ledger_sql(_LEDGER, 42, "SELECT s_suppkey::BIGINT AS s FROM supplier"))
def ledger_statements(spark, sf):
    """A statement for each supplier: wages and rent by month, everyday rows, no balance under the floor."""
    made = ledger.statements(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("statement")), _LEDGER, 42)
    return made.withColumn("seq", F.col("seq").cast("long"))


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS n_bad, 0::BIGINT AS n_repeated FROM customer")
def invoices_reconcile(spark, sf):
    return documents.check_invoices(documents.invoices(spark, table(spark, sf, "customer").count(), 42))


@query("SELECT (count(*) * 40)::BIGINT AS n, 0::BIGINT AS n_off, 0::BIGINT AS n_under FROM supplier")
def statements_reconcile(spark, sf):
    return documents.check_statements(documents.statements(spark, table(spark, sf, "supplier").count(), 40, 42, floor=50_000), 1_000_000, 50_000)


@query("SELECT c_custkey AS _rid, CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_mktsegment) THEN c_mktsegment ELSE c_mktsegment || '-' || c_custkey END AS v FROM customer")
def unique_repair(spark, sf):
    """Segments told apart by their customer; the first customer of each keeps it."""
    made = table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), F.col("c_mktsegment").alias("v"))
    return redraw.make_unique(made, "v")


@query(f"""WITH n AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation), bad AS (SELECT list(lower(n_name)) AS bad FROM nation WHERE n_regionkey < 2),
d AS (SELECT c_custkey, [{', '.join(f"names[1 + floor({_u('word', k=k)} * len(names))::INT]" for k in range(redraw.DRAWS + 1))}] AS d, bad FROM customer, n, bad)
SELECT c_custkey AS _rid, list_filter(d, lambda x: NOT list_contains(bad, lower(x)))[1] AS v FROM d""")
def forbidden_redraw(spark, sf):
    """A nation for each customer, none of the first two regions."""
    nations = table(spark, sf, "nation")
    names = [r[0] for r in nations.select("n_name").orderBy("n_nationkey").collect()]  # 25 names
    draw = lambda k: rng.pick(rng.uniform(42, "word", F.col("_rid"), k), names)
    made = table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid")).withColumn("v", draw(0))
    return redraw.avoid(made, "v", nations.where("n_regionkey < 2").select("n_name"), [draw(k + 1) for k in range(redraw.DRAWS)], 42)[0]


def _edit_sql(column: str, text: bool) -> str:
    u = lambda what: rng.uniform_sql(42, f"edit {what}:{column}", "r")
    if not text:
        return f"round(o * (0.99::DOUBLE + 0.02::DOUBLE * {u('side')}), 2)"
    at = f"(floor({u('place')} * (length(o) - 1)) + 1)::BIGINT"
    swapped, dropped = f"substr(o, 1, {at} - 1) || substr(o, {at} + 1, 1) || substr(o, {at}, 1) || substr(o, {at} + 2)", f"substr(o, 1, {at} - 1) || substr(o, {at} + 1)"
    return f"CASE WHEN {u('mode')} < 1 / 3e0 THEN {swapped} WHEN {u('mode')} < 2 / 3e0 THEN {dropped} WHEN upper(o) = o THEN lower(o) ELSE upper(o) END"


_r = lambda what: rng.uniform_sql(42, what, "r")


@query(f"""WITH c AS (SELECT c_custkey AS r, c_name AS n, c_acctbal AS b, CASE WHEN {_u('copy')} < 0.02 AND c_custkey > 0 THEN floor({_u('source')} * c_custkey)::BIGINT END AS s FROM customer),
x AS (SELECT c.r, c.n, c.b, o.n AS o_n, o.b AS o_b, o.r IS NOT NULL AS hit, floor({rng.uniform_sql(42, 'edited', 'c.r')} * 2) AS w FROM c LEFT JOIN c o ON o.r = c.s)
SELECT r AS _rid, CASE WHEN NOT hit THEN n WHEN w = 0 THEN (SELECT {_edit_sql('c_name', True)} FROM (SELECT x.o_n AS o)) ELSE o_n END AS c_name,
CASE WHEN NOT hit THEN b WHEN w = 1 THEN (SELECT {_edit_sql('c_acctbal', False)} FROM (SELECT x.o_b AS o)) ELSE o_b END AS c_acctbal, hit AS _copied FROM x""")
def near_duplicate_rows(spark, sf):
    """Customers, some of whom take an earlier one's name and balance with a small edit in one of them."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), "c_name", "c_acctbal")
    made = redraw.near_duplicates(rows, ["c_name", "c_acctbal"], 42)
    return made.withColumn("_copied", F.col("_copied") & F.col("c_name").isNotNull())


_S, _KEY = ColumnSpec, lambda n: ColumnSpec(n, "integer", "Identifier", "identifier", False, True)
_REF = lambda n: ColumnSpec(n, "integer", "Identifier", "identifier", False)
_SHOP = {
    "customers": [_KEY("customer_id"), _S("full_name", "string", "Person Name", privacy="high")], "products": [_KEY("product_id")], "suppliers": [_KEY("supplier_id")],
    "orders": [_KEY("order_id"), _REF("customer_id"), _S("order_date", "date", "Date", "datetime", False), _S("total_amount", "float", "Currency", "numeric", False)],
    "items": [_KEY("item_id"), _REF("order_id"), _REF("product_id"), _S("quantity", "integer", "Quantity", "numeric", False), _S("unit_price", "float", "Currency", "numeric", False)],
}
_ITEMS = relational.Relationship("orders", "order_id", "items", "order_id", 1, 4)
_SHOP_LINKS = (
    relational.Relationship("customers", "customer_id", "orders", "customer_id", 0, 3), _ITEMS, relational.Relationship("products", "product_id", "items", "product_id", None, None),
    relational.Relationship("suppliers", "supplier_id", "products", "product_id", 1, 4, "N:N"),
)


def _shop(spark, sf):
    """Customers, products and suppliers as many as there are real ones, their orders and items, and who supplies what."""
    rows = {t: table(spark, sf, real).count() for t, real in (("customers", "customer"), ("products", "part"), ("suppliers", "supplier"))}
    return design.run(spark, design.Design(_SHOP, rows, _SHOP_LINKS, (relational.Total(_ITEMS, "total_amount", "quantity * unit_price"),)), 42)


_shop_u = lambda t, stream, rid, k=0: rng.uniform_sql(design.table_seed(42, t), stream, rid, k)
_price_z = f"(sqrt(-2e0 * ln(1e0 - {_shop_u('items', 'unit_price', 'r', 1)})) * cos(2e0 * pi() * {_shop_u('items', 'unit_price', 'r', 2)}))"
_SHOP_SQL = f"""o AS (SELECT row_number() OVER (ORDER BY p, k) - 1 AS r, p + 1 AS customer_id FROM (SELECT p, unnest(range(0, floor({_shop_u('orders', 'children:orders', 'p')} * 4)::BIGINT)) AS k FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS p))),
i AS (SELECT row_number() OVER (ORDER BY p, k) - 1 AS r, p + 1 AS order_id FROM (SELECT r AS p, unnest(range(0, (1 + floor({_shop_u('items', 'children:items', 'r')} * 4))::BIGINT)) AS k FROM o)),
f AS (SELECT r + 1 AS item_id, order_id, floor({_shop_u('items', 'parent:items:product_id', 'r')} * (SELECT count(*) FROM part))::BIGINT + 1 AS product_id,
  floor(1 + {_shop_u('items', 'quantity', 'r')} * 20)::BIGINT AS quantity, round(least(greatest(exp(5.5::DOUBLE + {_price_z}), 1e0), 100000e0), 2) AS unit_price FROM i)"""


@query(f"WITH {_SHOP_SQL} SELECT * FROM f")
def design_items(spark, sf):
    """The items of a generated shop."""
    return _shop(spark, sf).tables["items"].select("item_id", "order_id", "product_id", "quantity", "unit_price")


@query(f"""WITH {_SHOP_SQL}, t AS (SELECT order_id, floor(sum(quantity * unit_price) * 100 + 0.5::DOUBLE) / 100 AS total_amount FROM f GROUP BY order_id)
SELECT r + 1 AS order_id, customer_id, (to_timestamp(1640995200 + floor({_shop_u('orders', 'order_date', 'r')} * 63072000)::BIGINT) AT TIME ZONE 'UTC')::DATE AS order_date, total_amount FROM o JOIN t ON t.order_id = r + 1""")
def design_orders(spark, sf):
    """The orders of a generated shop, each with the total of its items."""
    return _shop(spark, sf).tables["orders"].select("order_id", "customer_id", "order_date", "total_amount")


_T = "suppliers_products"


@query()
def design_links(spark, sf):
    """Who supplies what in a generated shop: one to four different products for each supplier."""
    return _shop(spark, sf).tables[_T].select("supplier_id", "product_id")


_PATTERN = "[A-C]{2}-[0-9]{4}(x|yz)?"


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_match FROM part")
def regex_generate(spark, sf):
    made = table(spark, sf, "part").select(rules.from_pattern(_PATTERN, 42, "p", F.col("p_partkey")).alias("v"))
    return made.agg(F.count("*").alias("n"), F.sum(F.col("v").rlike(f"^(?:{_PATTERN})$").cast("long")).alias("n_match"))


@query("SELECT count(*)::BIGINT AS n, (count(*) - 1)::BIGINT AS last_rid, count(*)::BIGINT AS n_distinct FROM lineitem")
def number_rows(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return relational.number_rows(table(spark, sf, "lineitem").select(*keys), keys).agg(F.count("*").alias("n"), F.max("_rid").alias("last_rid"), F.count_distinct("_rid").alias("n_distinct"))


@query("SELECT 0::BIGINT AS n_orphans, 0::BIGINT AS n_off")
def relational_end_to_end(spark, sf):
    """Customers, orders for each and items for each order; order totals follow their items; nothing dangles."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    orders = relational.children_of(customers, "customer_id", 0, 3, 42, "orders").select((F.col("fk") * 10 + F.col("_k")).alias("order_id"), F.col("fk").alias("customer_id"))
    items = relational.children_of(orders, "order_id", 1, 4, 42, "items").select((F.col("fk") * 10 + F.col("_k")).alias("item_id"), F.col("fk").alias("order_id"))
    items = items.withColumns({"quantity": rng.integer(rng.uniform(42, "quantity", F.col("item_id")), 1, 9), "unit_price": F.round(5 + 95 * rng.uniform(42, "price", F.col("item_id")), 2)})
    totals = relational.rule_values(orders, "order_id", items, "order_id", F.col("quantity") * F.col("unit_price"))
    final = orders.join(totals.withColumnRenamed("value", "total_amount"), "order_id")
    broken = relational.orphans(final, "customer_id", customers, "customer_id").unionByName(relational.orphans(items, "order_id", final, "order_id"))
    off = relational.reconcile(final, "order_id", "total_amount", totals)
    return broken.agg(F.sum("n_orphans").alias("n_orphans")).crossJoin(off.select("n_off"))


_COMPARED = "target string, metric string, trained_on string, score double, utility double, rating string"


def _compared(spark, found: utility.Comparison):
    sides = (("real", found.real), ("synthetic", found.synthetic))
    return spark.createDataFrame([(found.target, found.metric, n, round(x, 4), None if found.utility is None else round(found.utility, 4), found.rating) for n, x in sides], _COMPARED)


@query()
def tstr_orders(spark, sf):
    """Can an order's status be told from price, date and priority, and as well from synthetic orders? Without skill there is no utility."""
    orders = table(spark, sf, "orders").select(*[s.name for s in ORDERS])
    return _compared(spark, utility.tstr(orders, ORDERS, "o_orderkey", 7, "o_orderstatus"))


_SIGNS = [
    ColumnSpec("doc_id", "integer", "Identifier", "identifier", False, True), ColumnSpec("n_chars", "integer", "Quantity", "numeric"), ColumnSpec("lang", "string", "Category", "categorical"),
    ColumnSpec("capitals", "float", "Other", "numeric"), ColumnSpec("signs", "float", "Other", "numeric"), ColumnSpec("word_length", "float", "Other", "numeric"), ColumnSpec("quality", "string", "Category", "categorical"),
]


@query()
def tstr_documents(spark, sf):
    """Does a model of documents' quality, learnt from synthetic rows of simple measures, work on real ones?"""
    share = lambda pattern: F.round(1 - F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.length("text"), F.lit(1)), 4)
    words = F.greatest(F.size(F.split(F.trim("text"), "[ \\n\\t]+")), F.lit(1))
    # Texts are measured where they are read, so that no join carries them.
    measured = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", share("[A-Z]").alias("capitals"), share("[#*$%&|<>!]").alias("signs"), F.round(F.length("text") / words, 3).alias("word_length"))
    rows = measured.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    return _compared(spark, utility.tstr(rows, _SIGNS, "doc_id", 7, "quality"))


@query()
def generate_protected_orders(spark, sf):
    """Synthetic orders with a masked column and a rule that nothing breaks, and the report on them."""
    original = table(spark, sf, "orders").select(*[s.name for s in ORDERS])
    specs = [replace(s, transform="mask") if s.name == "o_orderpriority" else s for s in ORDERS]
    return tabular.checked(spark, specs, original.count(), 42, original, rule_list=(rules.Rule("range", "o_totalprice", low=1000.0, high=300_000.0),))[1]
