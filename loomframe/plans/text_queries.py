"""Text cells: readers, masks, escapes, search, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as T
from ..functions.dates import read_date
from ..operators import privacy
from ..sources import writers
from ..streaming import monitor
from .catalogue import query, table

_PRICE = "(CASE p_partkey % 5 WHEN 0 THEN '$' || round(p_retailprice, 0)::BIGINT::VARCHAR WHEN 1 THEN '1,250' WHEN 2 THEN p_retailprice::BIGINT::VARCHAR || 'd' WHEN 3 THEN ' Rs 99 ' ELSE '-' || p_partkey::VARCHAR END)"


@query(f"""WITH s AS (SELECT p_partkey, {_PRICE} AS s FROM part), b AS (SELECT p_partkey, s, regexp_replace(lower(trim(s)), '^(rs\\.?|\\$)\\s*', '') AS b FROM s)
SELECT p_partkey, CASE WHEN regexp_matches(replace(b, ',', ''), '^[+-]?[0-9]+$') THEN replace(b, ',', '')::DOUBLE END AS x FROM b""")
def number_reader(spark, sf):
    key, price = F.col("p_partkey"), F.round("p_retailprice", 0).cast("long").cast("string")
    s = F.when(key % 5 == 0, F.concat(F.lit("$"), price)).when(key % 5 == 1, "1,250").when(key % 5 == 2, F.concat(price, F.lit("d"))).when(key % 5 == 3, " Rs 99 ").otherwise(F.concat(F.lit("-"), key.cast("string")))
    return table(spark, sf, "part").select("p_partkey", T.number(s).alias("x"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders")
def date_reader_formats(spark, sf):
    """Dates written in five formats and read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyy/M/d")).when(k == 3, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "d.M.yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", read_date(text, True).alias("d"))


@query("""SELECT c_custkey, CASE WHEN lower(trim(s)) IN ('', 'null', 'nan', 'n/a', 'na', '#n/a', 'undefined', 'nil') THEN NULL ELSE trim(s) END AS cell
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' ELSE ' ' || c_name || ' ' END AS s FROM customer)""")
def cell_normalise(spark, sf):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, " N/A ").when(k == 1, "").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return table(spark, sf, "customer").select("c_custkey", T.cell(s).alias("cell"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a') ORDER BY p_partkey LIMIT 20 OFFSET 20""")
def search_page(spark, sf):
    """The second page of 20 rows in which any column holds the needle."""
    hit = F.lower("p_name").contains("a") | F.lower("p_brand").contains("a") | F.lower("p_type").contains("a")
    return table(spark, sf, "part").where(hit).select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").offset(20).limit(20)


_TEXT_SQL = "CASE WHEN length({0}) = 0 THEN {0} ELSE substr({0}, 1, 1) || repeat('*', least(length({0}) - 1, 12)::INT) END"
_MAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"


@query(f"SELECT c_custkey, substr({_MAIL}, 1, 1) || '****@example.com' AS mail, {_TEXT_SQL.format('c_name')} AS txt FROM customer")
def mask_email_text(spark, sf):
    mail = F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com"))
    return table(spark, sf, "customer").select("c_custkey", T.mask_email(mail).alias("mail"), T.mask_text(F.col("c_name")).alias("txt"))


@query("""WITH s AS (SELECT c_custkey, '+1-' || lpad(c_custkey::VARCHAR, 9, '5') || ' ext' AS s FROM customer), d AS (SELECT *, length(regexp_replace(s, '[^0-9]', '', 'g')) AS n FROM s)
SELECT c_custkey, list_reduce(list_prepend('', list_transform(string_split(s, ''), lambda c, i: CASE WHEN regexp_matches(c, '[0-9]') AND length(regexp_replace(substr(s, i), '[^0-9]', '', 'g')) > 4 THEN '*' WHEN regexp_matches(c, '[A-Za-z]') THEN '*' ELSE c END)), lambda a, b: a || b) AS m FROM d""")
def mask_last4(spark, sf):
    s = F.concat(F.lit("+1-"), F.lpad(F.col("c_custkey").cast("string"), 9, "5"), F.lit(" ext"))
    return table(spark, sf, "customer").select("c_custkey", T.mask_last4(s).alias("m"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = '' THEN w ELSE substr(w, 1, 1) || repeat('*', (length(w) - 1)::INT) END), ' ') AS m FROM part")
def mask_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.mask_name(F.col("p_name")).alias("m"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS h FROM customer")
def hash_sha256_16(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.hash16(F.col("c_name")).alias("h"))


_U = rng.uniform_sql(7, "noise:c_acctbal", "c_custkey")


@query(f"""WITH u AS (SELECT c_custkey, c_acctbal, {_U} - 0.5e0 AS x FROM customer) SELECT c_custkey, round(c_acctbal - 550e0 * sign(x) * ln(greatest(1e0 - 2e0 * abs(x), 1e-300)), 3) AS noisy FROM u""")
def laplace_noise(spark, sf):
    u = rng.uniform(7, "noise:c_acctbal", F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") + privacy.laplace(u, 550.0), 3).alias("noisy"))


@query("""SELECT 'c_name' AS "column", sum((substr(sha256(c_name), 1, 16) <> c_name)::INT)::BIGINT AS changed FROM customer UNION ALL SELECT 'c_mktsegment', 0::BIGINT""")
def privacy_report_changed(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return privacy.changes(c, privacy.protect(c, {"c_name": "hash"}, "c_custkey"), "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT n_nationkey, translate('٣' || n_name || '۷', '٣۷', '37') AS s FROM nation")
def digits_normalise(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.ascii_digits(F.concat(F.lit("٣"), "n_name", F.lit("۷"))).alias("s"))


_ODD = "(CASE p_partkey % 5 WHEN 0 THEN '=' || p_name WHEN 1 THEN '-' || p_partkey::VARCHAR WHEN 2 THEN p_name || ', \"x\"' WHEN 3 THEN ' ' || p_name ELSE p_name END)"


@query(f"""WITH s AS (SELECT p_partkey, {_ODD} AS s FROM part), g AS (SELECT p_partkey, CASE WHEN regexp_matches(s, '^[=+@-]') AND NOT regexp_matches(s, '^[+-]?[0-9]+$') THEN '''' || s ELSE s END AS s FROM s)
SELECT p_partkey, s AS guarded, CASE WHEN regexp_matches(s, '[",]|^ | $') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS field FROM g""")
def csv_escape(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    s = F.when(k % 5 == 0, F.concat(F.lit("="), n)).when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 2, F.concat(n, F.lit(', "x"'))).when(k % 5 == 3, F.concat(F.lit(" "), n)).otherwise(n)
    return table(spark, sf, "part").select("p_partkey", T.csv_guard(s).alias("guarded"), T.csv_field(s).alias("field"))


@query("""SELECT (sum(strlen(doc_id::VARCHAR) + strlen(text) + CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN 2 + length(text) - length(replace(text, '"', '')) ELSE 0 END + strlen(lang) + 3) + 17)::BIGINT AS n_bytes FROM documents""")
def csv_size(spark, sf):
    return writers.csv_size(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("""SELECT c AS "column", CASE c WHEN 'c_custkey' THEN 'BIGINT' WHEN 'c_acctbal' THEN 'NUMERIC(20,2)' ELSE 'VARCHAR(' || greatest(16, pow(2, ceil(log2(n)))::INT)::VARCHAR || ')' END AS sql_type, true AS not_null
FROM (SELECT 'c_custkey' AS c, 1 AS n UNION ALL SELECT 'c_name', (SELECT max(length(c_name)) FROM customer) UNION ALL SELECT 'c_acctbal', 1 UNION ALL SELECT 'c_mktsegment', (SELECT max(length(c_mktsegment)) FROM customer))""")
def sql_type(spark, sf):
    return writers.sql_columns(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@query("""SELECT o_orderkey, '''' || replace(o_orderstatus || '''s', '''', '''''') || '''' AS t, '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' AS d, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END AS b FROM orders""")
def sql_literals(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", T.sql_literal(F.concat(s, F.lit("'s")), "string").alias("t"), T.sql_literal(F.col("o_orderdate"), "date").alias("d"), T.sql_literal(F.when(s == "F", "yes").otherwise("no"), "boolean").alias("b"))


@query("""SELECT floor(n_nationkey / 500)::BIGINT AS batch, 'INSERT INTO "nation" ("n_nationkey", "n_name") VALUES' || chr(10) || string_agg('(' || n_nationkey || ', ''' || n_name || ''')', ',' || chr(10) ORDER BY n_nationkey) || ';' AS statement FROM nation GROUP BY 1""")
def sql_inserts(spark, sf):
    return writers.sql_inserts(table(spark, sf, "nation").select(F.col("n_nationkey").alias("_rid"), "n_nationkey", "n_name"), "nation", "_rid")


@query("""SELECT event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND floor(epoch(b.ts)) BETWEEN floor(epoch(a.ts)) - 60 AND floor(epoch(a.ts)))::BIGINT AS n FROM events a""")
def request_density_60s(spark, sf):
    return table(spark, sf, "events").select("event_id", monitor.density("user_id", "ts").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, ts, k, true AS admitted, [t] AS recent FROM r WHERE k = 1
UNION ALL SELECT user_id, event_id, ts, k, len(l) < 3, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END FROM (SELECT r.*, [x FOR x IN f.recent IF x > r.t - 86400] AS l FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1))
SELECT user_id, event_id, ts, admitted FROM f""")
def rate_limit_admission(spark, sf):
    return monitor.admitted(table(spark, sf, "events").select(F.col("user_id"), "event_id", "ts"), "user_id", "ts", "event_id", limit=3, seconds=86_400)
