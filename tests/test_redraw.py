"""Permutations, redraws with their log, uniqueness, near-duplicate rows, and designs of linked tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe.functions import permute, rng
from loomframe.operators import design, generate, redraw, relational, rules, tabular
from loomframe.operators.infer import ColumnSpec


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 11, 97, 100, 101, 1009, 4999])
def test_permutation(spark, n):
    rows = spark.range(n).select(*[permute.permuted(F.col("id"), n, seed, "p").alias(f"p{seed}") for seed in (1, 2)]).collect()
    assert sorted(r.p1 for r in rows) == sorted(r.p2 for r in rows) == list(range(n))
    assert n < 20 or [r.p1 for r in rows] != [r.p2 for r in rows] != list(range(n))


def test_grids_have_few_spare_cells():
    draw = random.Random(1)
    for n in [*range(1, 400), *[draw.randint(10**6, 10**9) for _ in range(50)]]:
        a, b = permute.grid(n)
        assert 0 <= a * b - n <= (6 if n < 400 else 60) and a <= 2 * b + 2


def test_partners_do_not_follow_each_other(spark):
    rows = spark.range(3000).select(F.col("id").alias("a"))
    out = relational.many_to_many(rows, "a", 101, 3, 3, 5, "t").groupBy("a").agg(F.collect_set("b").alias("b")).collect()
    assert all(len(r.b) == 3 and max(r.b) < 101 for r in out)
    steps = {tuple(sorted((x - min(r.b)) % 101 for x in r.b)) for r in out}
    assert len(steps) > 1500, "no pattern is shared by all rows"
    counts = {r.b: r["count"] for r in relational.many_to_many(rows, "a", 101, 3, 3, 5, "t").groupBy("b").count().collect()}
    assert len(counts) == 101 and max(counts.values()) < 2 * 9000 / 101


def test_forbidden_values_and_replay(spark):
    spec = ColumnSpec("who", "string", "Person Name", privacy="high")
    make = lambda **o: tabular.drawn(spark, [spec], 400, 3, **o)
    plain = {r._rid: r.who for r in make()[0].collect()}
    names = sorted(set(plain.values()))
    bad = spark.createDataFrame([(f"  {x.upper()} ",) for x in names[: len(names) // 2]], "v string")
    made, log = make(forbidden={"who": bad})
    made = {r._rid: r.who for r in made.collect()}
    taken = {x.lower() for x in names[: len(names) // 2]}
    assert not {v.lower() for v in made.values()} & taken
    assert {i for i in plain if plain[i] != made[i]} == {r._rid for r in log.collect()} == {i for i in plain if plain[i].lower() in taken}
    again = {r._rid: r.who for r in make(log=log)[0].collect()}
    assert again == made and set(log.columns) == {"column", "_rid", "draws", "suffixes"}


def test_every_draw_and_suffix_forbidden(spark):
    rows = spark.range(40).select(F.col("id").alias("_rid"), F.lit("ann").alias("v"), F.lit(5).alias("n"))
    draws = [F.lit("Ann"), F.lit("bob")]
    first = [f"bob {chr(65 + i)}." for i in range(26)]
    bad = spark.createDataFrame([(x,) for x in ["ann", "BOB", *first]], "v string")
    made, log = redraw.avoid(rows, "v", bad, draws, 1)
    values = [r.v for r in made.collect()]
    assert all(re.fullmatch(r"bob( [A-Z]\.){2}", v) for v in values) and {(r.draws, r.suffixes) for r in log.collect()} == {(2, 2)}
    numbers = spark.createDataFrame([(str(k),) for k in range(5, 40)], "v string")
    made, log = redraw.avoid(rows, "n", numbers, [F.lit(6), F.lit(7)], 1)
    assert {r.n for r in made.collect()} == {40} and {(r.draws, r.suffixes) for r in log.collect()} == {(2, 33)}
    assert {r.n for r in redraw.replay(rows, "n", log, [F.lit(6), F.lit(7)], 1).collect()} == {40}
    none, log = redraw.avoid(rows, "v", spark.createDataFrame([(None,), ("zoe",)], "v string"), draws, 1)
    assert none.count() == 40 and log.count() == 0


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_uniqueness(spark, kind):
    draw = random.Random(4)
    values = {"string": ["seg", "seg-5", "seg-6", "a@b.c", "a.7@b.c", None], "bigint": [1, 2, 6, 9, None], "double": [1.0, 1.05, 1.06, None]}[kind]
    rows = [(i, draw.choice(values)) for i in range(60)]
    df = spark.createDataFrame(rows, f"_rid long, v {kind}")
    out = {r._rid: r.v for r in redraw.make_unique(df, "v").collect()}
    full = [v for v in out.values() if v is not None]
    assert len(set(full)) == len(full) and {i for i, v in rows if v is None} == {i for i, v in out.items() if v is None}
    for v in values:
        holders = [i for i, x in rows if x == v]
        if v is not None and holders:
            assert out[min(holders)] == v, "the first row keeps its value"
    if kind == "string":
        assert all(re.fullmatch(r"(seg(-\d+)*)|(a(\.\d+)*@b\.c)", v) for v in full)


def test_uniqueness_by_redraws(spark):
    rows = spark.range(30).select(F.col("id").alias("_rid"), F.lit("x").alias("v"))
    draws = [F.concat(F.lit("d"), (F.col("_rid") % 10).cast("string")), F.concat(F.lit("e"), F.col("_rid").cast("string"))]
    out = sorted(r.v for r in redraw.make_unique(rows, "v", draws).collect())
    assert len(set(out)) == 30 and "x" in out and sum(v[0] == "d" for v in out) == 10 and not any("-" in v for v in out)


def test_near_duplicates(spark):
    specs = [ColumnSpec("id", "integer", "Identifier", "identifier", False, True), ColumnSpec("name", "string", "Person Name"), ColumnSpec("n", "integer", "Quantity", "numeric"), ColumnSpec("x", "float", "Currency", "numeric")]
    plain = {r._rid: r for r in generate.cells(spark, specs, 3000, 2).collect()}
    made, _ = tabular.drawn(spark, specs, 3000, 2, config=generate.Config(duplicate_rate=0.1))
    by = {}
    for r in plain.values():
        by.setdefault((r.name, r.n, r.x), set()).add(r._rid)
    changed = [r for r in made.collect() if (r.name, r.n, r.x) != (plain[r._rid].name, plain[r._rid].n, plain[r._rid].x)]
    assert 200 < len(changed) < 400 and len({r.id for r in made.collect()}) == 3000
    kinds = set()
    for r in changed:
        sources = [s for s in plain.values() if s._rid < r._rid and sum(a == b for a, b in ((s.name, r.name), (s.n, r.n), (s.x, r.x))) >= 2]
        assert sources and sum(f == 6 for f in (r._f_name, r._f_n, r._f_x)) == 1
        edits = [(s.name, r.name) for s in sources if s.name != r.name]
        if r._f_n == 6:
            assert any(abs(s.n - r.n) == 1 for s in sources)
        elif r._f_x == 6:
            assert any(abs(s.x - r.x) <= 0.0101 * s.x + 0.01 for s in sources)
        elif edits:
            kinds |= {"flip" if r.name.lower() == a.lower() else "drop" if len(r.name) == len(a) - 1 else "swap" if sorted(a) == sorted(b) else "?" for a, b in edits if a.lower() == b.lower() or abs(len(a) - len(b)) < 2}
    assert {"flip", "drop", "swap"} <= kinds


KEY = lambda n: ColumnSpec(n, "integer", "Identifier", "identifier", False, True)
REF = lambda n, unique=False: ColumnSpec(n, "integer", "Identifier", "identifier", False, unique)
MONEY = lambda n, nullable=False: ColumnSpec(n, "float", "Currency", "numeric", nullable)


def shop():
    tables = {
        "order_items": [KEY("item_id"), REF("order_id"), ColumnSpec("quantity", "integer", "Quantity", "numeric", False), MONEY("unit_price", True)],
        "orders": [KEY("order_id"), REF("customer_id"), ColumnSpec("order_date", "date", "Date", "datetime", False), MONEY("total_amount")],
        "customers": [KEY("customer_id"), ColumnSpec("name", "string", "Person Name", privacy="high", transform="mask"), MONEY("spent")],
    }
    items = relational.Relationship("orders", "order_id", "order_items", "order_id", 1, 4)
    orders = relational.Relationship("customers", "customer_id", "orders", "customer_id", 1, 5)
    totals = (relational.Total(items, "total_amount", "quantity * unit_price"), relational.Total(orders, "spent", "total_amount"))
    return design.Design(tables, {"customers": 100, "orders": 300, "order_items": 750}, (items, orders), totals, {"order_items": (rules.Rule("range", "quantity", low=1, high=5), rules.Rule("range", "order_id", low=-9, high=-1))})


def test_design(spark):
    made = design.run(spark, shop(), 42, config=generate.Config(null_rate=0.1))
    assert made.order == ["customers", "orders", "order_items"]
    data = {t: df.collect() for t, df in made.tables.items()}
    assert len(data["customers"]) == 100 and len({r.customer_id for r in data["customers"]}) == 100
    assert {r._rid for r in data["orders"]} == set(range(len(data["orders"]))) and made.rows["orders"] == len(data["orders"])
    for parent, key, child in (("customers", "customer_id", "orders"), ("orders", "order_id", "order_items")):
        keys, n = {r[key] for r in data[parent]}, {}
        for r in data[child]:
            n[r[key]] = n.get(r[key], 0) + 1
        assert set(n) == keys and min(n.values()) >= 1 and max(n.values()) <= (5 if child == "orders" else 4)
    want, spent = {}, {}
    for r in data["order_items"]:
        assert 1 <= r.quantity <= 5
        if r.unit_price is not None:
            want[r.order_id] = want.get(r.order_id, 0) + r.quantity * r.unit_price
    for r in data["orders"]:
        assert abs(r.total_amount - want.get(r.order_id, 0)) <= 0.01
        spent[r.customer_id] = spent.get(r.customer_id, 0) + r.total_amount
    assert all(abs(r.spent - spent[r.customer_id]) <= 0.01 and (r.name is None or "*" in r.name) for r in data["customers"])
    again = design.run(spark, shop(), 42, config=generate.Config(null_rate=0.1))
    assert {t: sorted(map(repr, df.collect())) for t, df in again.tables.items()} == {t: sorted(map(repr, own)) for t, own in data.items()}


def test_design_with_other_links(spark):
    tables = {
        "users": [KEY("user_id"), ColumnSpec("mail", "email", "Email", unique=True)], "profiles": [KEY("profile_id"), REF("user_id", True), ColumnSpec("contact", "email", "Email")],
        "courses": [ColumnSpec("course_code", "string", "Identifier", "identifier", False, True)], "empty": [KEY("id")], "notes": [KEY("note_id"), REF("user_id"), REF("none")],
    }
    R = relational.Relationship
    links = (R("users", "user_id", "profiles", "user_id", None, None, "1:1"), R("users", "user_id", "courses", "course_code", 2, 4, "N:N"), R("users", "user_id", "notes", "user_id", None, None), R("empty", "id", "notes", "none", None, None), R("users", "mail", "profiles", "contact", None, None))
    made = design.run(spark, design.Design(tables, {"users": 40, "profiles": 60, "courses": 10, "notes": 50}, links), 1)
    data = {t: df.collect() for t, df in made.tables.items()}
    assert len(data["profiles"]) == 40 == len({r.user_id for r in data["profiles"]}) and {r.contact for r in data["profiles"]} <= {r.mail for r in data["users"]}
    pairs = [tuple(r)[1:] for r in data["users_courses"]]
    codes = {r.course_code for r in data["courses"]}
    assert len(set(pairs)) == len(pairs) and {b for _, b in pairs} <= codes and all(2 <= sum(a == u for a, _ in pairs) <= 4 for u in {a for a, _ in pairs})
    assert len(data["notes"]) == 50 and {r.none for r in data["notes"]} == {None} and {r.user_id for r in data["notes"]} <= {r.user_id for r in data["users"]}
    with pytest.raises(ValueError, match="does not exist"):
        design.run(spark, design.Design(tables, {}, (R("users", "nope", "notes", "user_id"),)), 1)


def test_cells_by_meaning(spark):
    specs = [
        ColumnSpec("code", "string", "Identifier", "identifier", False, True), ColumnSpec("ssn", "string", "Identifier", "text", privacy="high", transform="mask"), ColumnSpec("login", "string", "Identifier", "text", privacy="medium", transform="synthetic"),
        ColumnSpec("tone", "string", "Category", "categorical"), ColumnSpec("note", "string", "Description"), ColumnSpec("n", "integer", "Quantity", "numeric"),
    ]
    profile = generate.Profile({"code": generate.ColumnProfile("key", sample="INV-00041"), "n": generate.ColumnProfile("numeric", quantiles=[float(x) for x in range(-50, 51)], spread=29.0)}, [], None)
    config = generate.Config(outlier_rate=0.1, boundary_rate=0.1, long_text_rate=0.1, edge_rate=0.1, pools={"tone": ("warm", "cold")}, edges={"n": (7777, "x"), "tone": ("??",)})
    rows = generate.generate(spark, specs, 800, 9, profile, config).collect()
    assert [r.code for r in sorted(rows, key=lambda r: r._rid)][:2] == ["INV-00041", "INV-00042"]
    assert all(re.fullmatch(r"\d{3}-\d\d-\d{4}", r.ssn) and re.fullmatch(r"[a-z]+\.[a-z]+\d{1,2}", r.login) for r in rows)
    assert {r.tone for r in rows} == {"warm", "cold", "??"} and all((r.tone == "??") == (r._f_tone == 7) for r in rows)
    far = [r.n for r in rows if r._f_n == 2]
    assert far and all(abs(x) > 50 for x in far) and min(far) < -50 and max(far) > 50
    assert {r.n for r in rows if r._f_n == 3} == {-50, 50, 0} and {r.n for r in rows if r._f_n == 7} == {7777, None}
    long = [r.note for r in rows if r._f_note == 5]
    assert long and all(500 <= len(x) <= 2000 for x in long) and len({x[-40:] for x in long}) == len(long)


def test_draws_are_new(spark):
    spec = ColumnSpec("who", "string", "Person Name")
    draws = generate.redrawn(spec, 1, None, generate.Config(), 3)
    row = spark.range(500).select(F.col("id").alias("_rid")).select(*[(draws[i] == draws[j]).cast("int").alias(f"s{i}{j}") for i, j in ((0, 1), (1, 2))]).agg(F.sum("s01"), F.sum("s12")).first()
    assert max(row) < 20 and rng.fnv1a("a") == 0xE40C292C
