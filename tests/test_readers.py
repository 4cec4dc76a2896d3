"""Ragged CSV rows and the order of JSON keys, over whole files."""

import json

import pytest

from loomframe.operators import relational
from loomframe.sources import readers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_first_bad_line(spark, tmp_path):
    body = "".join(f"{i},x\n" if i != 7 else "7\n" if i == 7 else "" for i in range(30)) + ",\n\n30,a,b\n"
    df, report = readers.read_csv_report(spark, put(tmp_path, "a.csv", "id,v\n" + body))
    assert (report.n_rows, report.n_bad, report.first_bad) == (31, 2, 9) and "line 9" in report.warnings[0]
    rows = {r.id: r.v for r in df.collect()}
    assert rows["7"] is None and rows["30"] == "a" and len(rows) == 31
    _, fine = readers.read_csv_report(spark, put(tmp_path, "b.csv", 'id,v\n1,"a\nb"\n2,c\n'))
    assert (fine.n_rows, fine.n_bad, fine.first_bad, fine.warnings) == (2, 0, None, ())
    with pytest.raises(readers.ReadError, match="3 of 4 rows .* line 3"):
        readers.read_csv(spark, put(tmp_path, "c.csv", "id,v\n1,2\n1\n2\n3,4,5\n"))


def test_keys_by_first_appearance(spark, tmp_path):
    rows = [{"z": 1, "b": 2}] * 40 + [{"late": 3, "b": 1}, {"a": 1, "z": 0}]
    lines = put(tmp_path, "a.ndjson", "\n".join(map(json.dumps, rows)) + "\n")
    assert readers.read_table(spark, lines).columns == ["z", "b", "late", "a"]
    assert readers.read_table(spark, put(tmp_path, "b.json", "﻿" + json.dumps(rows, indent=1))).columns == ["z", "b", "late", "a"]
    wrapped = readers.read_table(spark, put(tmp_path, "c.json", json.dumps({"meta": 1, "data": rows}, indent=1)))
    assert wrapped.columns == ["z", "b", "late", "a"] and wrapped.count() == 42


def test_items_that_are_no_objects(spark, tmp_path):
    for name, text, item in (("a.json", '[{"a": 1}, 5, {"a": 2}]', 2), ("b.json", '[{"a": 1}, {"a": 3}, [1]]', 3)):
        with pytest.raises(readers.ReadError, match=f"item {item} is not an object"):
            readers.read_table(spark, put(tmp_path, name, text))
    with pytest.raises(readers.ReadError):
        readers.read_table(spark, put(tmp_path, "c.json", "not json at all"))


def test_link_report(spark):
    parents = spark.createDataFrame([(i,) for i in range(5)], "id long")
    children = spark.createDataFrame([(0,), (0,), (0,), (1,), (9,), (None,)], "pid long")
    R = relational.Relationship
    many, single = relational.link_report({"p": parents, "c": children}, [R("p", "id", "c", "pid", 1, 2), R("p", "id", "c", "pid", None, None, "1:1")]).collect()
    assert many.link == "c.pid -> p.id" and (many.n_fk, many.n_null, many.n_orphans, many.n_childless, many.min_children, many.max_children) == (5, 1, 1, 3, 0, 3)
    assert (many.n_under, many.n_over, many.status, many.integrity) == (3, 1, "failed", 66.7) and (single.n_under, single.n_over) == (0, 1)
    good = relational.link_report({"p": parents, "c": parents}, [R("p", "id", "c", "id", 1, 1)]).first()
    assert good.status == "passed" and good.integrity == 100.0
