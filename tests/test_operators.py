"""Operators that are not rows of a query: files, schemas, rules, patterns, periods, order of generation."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.functions.dates import read_date
from loomframe.operators import documents, generate, infer, relational, rules, utility
from loomframe.operators.infer import ColumnSpec
from loomframe.sources import readers, writers
from loomframe.streaming import monitor

SPECS = [ColumnSpec("id", "integer", "Identifier", "identifier", False, True), ColumnSpec("name", "string", "Person Name"), ColumnSpec("email", "email", "Email", unique=True), ColumnSpec("age", "integer", "Age", "numeric"), ColumnSpec("city", "string", "City", "categorical")]


def test_same_seed_same_rows(spark):
    make = lambda parts: sorted(map(repr, generate.generate(spark, SPECS, 300, 5, config=generate.Config(null_rate=0.1)).repartition(parts).collect()))
    assert make(1) == make(7)
    assert make(1) != sorted(map(repr, generate.generate(spark, SPECS, 300, 6).collect()))


@pytest.mark.parametrize("n", [1, 20, 500])
def test_counts_and_unique(spark, n):
    df = generate.generate(spark, SPECS, n, 1)
    row = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("email").alias("mails"), F.min("age").alias("lo"), F.max("age").alias("hi")).first()
    assert (row.n, row.ids, row.mails) == (n, n, n) and 18 <= row.lo <= row.hi <= 85


def test_null_rate(spark):
    df = generate.generate(spark, SPECS, 5000, 1, config=generate.Config(null_rate=0.3))
    assert abs(df.where("city IS NULL").count() / 5000 - 0.3) < 0.03
    assert df.where("_f_city = 1").count() == df.where("city IS NULL").count()


def test_cholesky():
    m = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    assert np.allclose((generate.cholesky(m) ** 2).sum(axis=1), 1)


@pytest.mark.parametrize(("value", "want"), [("1,250", 1250), ("$99", 99), ("Rs 1,200", 1200), ("1e5", 1e5), ("NaN", None), ("1d", None), ("Infinity", None), ("1,25", None), ("", None), (None, None)])
def test_number(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(T.number(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(("value", "day_first", "want"), [("31/02/2024", True, None), ("1/1/2024", True, "2024-01-01 00:00:00"), ("13/01/2024", True, "2024-01-13 00:00:00"), ("01/13/2024", False, "2024-01-13 00:00:00"), ("2024-01-31T10:00:00+05:00", True, "2024-01-31 05:00:00"), ("1/2/2024 12:30 AM", True, "2024-02-01 00:30:00"), ("Mar 5, 2024", True, "2024-03-05 00:00:00"), ("soon", True, None)])
def test_date(spark, value, day_first, want):
    got = spark.createDataFrame([(value,)], "v string").select(F.date_format(read_date(F.col("v"), day_first), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


@pytest.mark.parametrize(("value", "want"), [("=1+1", "'=1+1"), ("-5", "-5"), ("+cmd", "'+cmd"), ("@x", "'@x"), ("a", "a"), ("-1.5e3", "-1.5e3")])
def test_csv_guard(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(T.csv_guard(F.col("v"))).first()[0] == want


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id; name ;;id\n1;x;n/a;2\n \n2;\"y;z\";;3\n", encoding="utf-8")
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "column_3", "id_2"]
    assert sorted(map(tuple, df.collect())) == [("1", "x", None, "2"), ("2", "y;z", None, "3")]
    writers.write_csv(df, str(tmp_path / "out"))
    assert sum("\r\n" in p.read_bytes().decode() for p in (tmp_path / "out").glob("part*")) >= 1


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"b": 1, "a": {"x": 2}}, {"b": null}]}')
    assert sorted(map(str, (r.asDict()["b"] for r in readers.read_table(spark, str(tmp_path / "a.json")).collect()))) == ["1", "None"]
    (tmp_path / "b.ndjson").write_text('{"b": "x", "a": "1"}\n{"a": "nan"}\n')
    assert readers.read_table(spark, str(tmp_path / "b.ndjson")).columns == ["b", "a"]


@pytest.mark.parametrize(("name", "thing"), [("product_name", True), ("city_name", True), ("surname", False), ("customer_name", False), ("full_name", False), ("name", False)])
def test_thing_names(name, thing):
    assert infer.is_thing(name) is thing


def test_infer(spark):
    df = spark.createDataFrame([(str(i), f"p{i}@example.com", "yes" if i % 2 else "no", f"{i}.5", f"2024-01-{i % 28 + 1:02d}", "007") for i in range(100)], "user_id string, mail string, active string, price string, day string, zip string")
    assert [s.type for s in infer.infer(df)] == ["integer", "email", "boolean", "float", "date", "string"]


PEOPLE = "name full_name first_name surname applicant_name planner_name teammate_name job_seeker_name project_manager_name statement_holder_name patient_name customer_name employee_name student_name guardian_name driver_name contact_name team_lead_name".split()
THINGS = "product_name company_name app_name bank_name team_name plan_name city_name file_name game_name event_name hotel_name vendor_name product_category_name hospital_name brand_name employer_name order_name restaurant_name".split()
PRIVATE = {"ssn": "mask", "cnic": "mask", "passport_no": "mask", "iban": "mask", "cardNumber": "mask", "tax_id": "mask", "ipv4": "mask", "ip_address": "mask", "date_of_birth": "synthetic", "dob": "synthetic", "e_mail": "synthetic", "mobile": "synthetic", "home_address": "synthetic", "zip_code": "synthetic"}
OPEN = {"username": ("Identifier", "medium", "synthetic"), "order_id": ("Identifier", "medium", "preserve"), "province": ("Address", "low", "preserve"), "home_town": ("City", "medium", "preserve"), "vendor": ("Company", "low", "preserve"), "website": ("URL", "low", "preserve"), "remarks": ("Description", "low", "preserve")}


def test_names_and_privacy(spark):
    names = [*PEOPLE, *THINGS, *PRIVATE, *OPEN]
    df = spark.createDataFrame([tuple(f"Alpha Beta {i}" for _ in names) for i in range(30)], ", ".join(f"{n} string" for n in names))
    found = {s.name: s for s in infer.infer(df)}
    assert all(found[n].semantic == "Person Name" and (found[n].privacy, found[n].transform) == ("high", "synthetic") for n in PEOPLE)
    assert [n for n in THINGS if found[n].semantic == "Person Name"] == []
    assert {n: (found[n].privacy, found[n].transform) for n in PRIVATE} == {n: ("high", t) for n, t in PRIVATE.items()}
    assert {n: (found[n].semantic, found[n].privacy, found[n].transform) for n in OPEN} == OPEN
    for n, t in PRIVATE.items():
        assert infer.default_privacy(n, found[n].semantic) == ("high", t)


def test_values_decide(spark):
    rows = [(str(i + 1), f"www.site{i}.org/a", ["France", "de", "Japan"][i % 3], "y" if i % 2 else "n", str(i % 2), f"+44 20 7946 {i:04d}", f"$1,2{i:02d}.50", f"{i:05d}", "x" * 70 + str(i), None if i < 5 else "red") for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, is_open string, f string, g string, h string, i string, j string")
    found = {s.name: (s.type, s.semantic, s.kind) for s in infer.infer(df)}
    assert found == {"a": ("integer", "Identifier", "identifier"), "b": ("string", "URL", "text"), "c": ("string", "Country", "categorical"), "d": ("boolean", "Category", "boolean"), "is_open": ("boolean", "Category", "boolean"),
                     "f": ("string", "Phone", "text"), "g": ("float", "Currency", "numeric"), "h": ("string", "Other", "text"), "i": ("string", "Description", "text"), "j": ("string", "Category", "categorical")}
    assert {s.name: s.pattern for s in infer.infer(df)}["j"] == "1 distinct values · 8.3% missing" and infer.summary(infer.infer(df))["dates"] == 0


def test_order():
    R = relational.Relationship
    assert relational.generation_order(["c", "b", "a"], [R("a", "id", "b", "a_id"), R("b", "id", "c", "b_id")]) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="->"):
        relational.generation_order(["a", "b"], [R("a", "id", "b", "x"), R("b", "id", "a", "x")])


def test_pattern(spark):
    for pattern in ("[A-Z]{3}-\\d{2,4}", "(ab|cd)+x?", "a.c"):
        df = spark.range(200).select(rules.from_pattern(pattern, 1, "t", F.col("id")).alias("v"))
        assert df.where(~F.col("v").rlike(f"^(?:{pattern})$")).count() == 0


TODAY = date(2026, 9, 29)


@pytest.mark.parametrize(("text", "want"), [("last 90 days", (date(2026, 7, 1), TODAY)), ("last month", (date(2026, 8, 30), TODAY)), ("Q1 2026", (date(2026, 1, 1), date(2026, 3, 31))), ("Q4 2025", (date(2025, 10, 1), date(2025, 12, 31))), ("february 2024", (date(2024, 2, 1), date(2024, 2, 29))), ("in 2025", (date(2025, 1, 1), date(2025, 12, 31))), ("sometime", None)])
def test_period(text, want):
    assert documents.parse_period(text, TODAY) == want


def test_request():
    got = documents.parse_request("3 statements, last 90 days, 60 transactions, never below 500, opening balance of 10k", TODAY)
    assert (got["count"], got["transactions"], got["floor"], got["opening"]) == (3, 60, 500, 10_000)


def test_utility():
    assert utility.utility(0.9, 0.86, 0.5) == pytest.approx(0.9) and utility.utility(0.52, 0.5, 0.5) is None


def test_rejected_requests_do_not_count():
    assert monitor._admit([0, 1, 2, 61], [], 2, 60)[0] == [True, True, False, True]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 50)], "id int, v int").write.parquet(str(tmp_path / "in"))
    seen = []
    q = monitor.check_batches(spark.readStream.schema("id int, v int").parquet(str(tmp_path / "in")), [rules.Rule("range", "v", low=0, high=10)], lambda k, r: seen.append(r.first())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen[0].v0 == 1 and seen[0].n_passing == 1


def test_design():
    key = lambda n, t="integer": infer.ColumnSpec(n, t)
    specs = {"students": [key("id"), key("fees", "float")], "courses": [key("id")], "marks": [key("student_id"), key("points", "float")]}
    links = [relational.Relationship("students", "id", "courses", "id", 1, 3, "N:N"), relational.Relationship("students", "id", "marks", "student_id", 2, 4)]
    wide, direct, joins = relational.expand_many_to_many(specs, links)
    assert [s.name for s in wide["students_courses"]] == ["student_id", "course_id"] and len(direct) == 3 and list(joins) == ["students_courses"]
    assert relational.design_problems(specs, links) == []
    assert relational.estimate_rows({"students": 100, "courses": 10, "marks": 7}, links) == {"students": 100, "courses": 10, "marks": 300, "students_courses": 200}
    bad = [relational.Relationship("students", "id", "marks", "none", 5, 2), relational.Relationship("courses", "id", "marks", "student_id", 0, 2)]
    assert len(relational.design_problems(specs, bad)) == 3 and relational.design_problems({}, []) == ["there is no table"]
    loop = [relational.Relationship("students", "id", "marks", "student_id"), relational.Relationship("marks", "points", "students", "id")]
    assert "circle" in relational.design_problems(specs, loop)[0]


def test_rule_problems():
    kinds = {"age": "integer", "name": "string", "born": "date"}
    R = rules.Rule
    good = [R("range", "age", low=1), R("allowed", "name", values=("a",)), R("pattern", "name", pattern="a+"), R("range", "born", low=1, high=2)]
    bad = [R("range", "name", low=1), R("range", "age"), R("range", "age", low=3, high=2), R("allowed", "name"), R("pattern", "name", pattern="("), R("compare", "age", other="born"), R("compare", "age", other="none"), R("compare", "age", other="age")]
    assert [rules.problem(r, kinds) for r in good] == [None] * 4 and all(rules.problem(r, kinds) for r in bad)
    assert rules.describe(R("range", "age", low=1, high=9)) == "age is at least 1 and at most 9"
    assert rules.for_table([R("compare", "t.a", other="t.b"), R("range", "u.a", low=1)], "t") == [R("compare", "a", other="b")]


def test_username_and_keys(spark):
    row = spark.range(1).select(generate.username(F.lit("Ann-Lee"), F.lit("O'Hara"), 1, F.col("id")).alias("u"), generate.string_key(None, F.col("id")).alias("k"), generate.fill_template("##-A", 1, "t", F.col("id")).alias("t")).first()
    assert row.u.startswith("annlee.ohara") and row.k == "ID-000001" and row.t[2] == "-" and row.t[3].isupper()


def test_classes_from_categories(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, " Red").when(F.col("id") % 7 == 0, None).otherwise("blue").alias("c"), (F.col("id") % 2 == 0).alias("y"))
    train, test = utility.split(rows, "id", 3)
    assert utility.accuracy(utility.forest_values(train, test, [], ["c"], "y"), "predicted", "label").first().accuracy == 1.0
    assert utility.predictable("auc", 0.7) and not utility.predictable("accuracy", 0.52, 0.5)
