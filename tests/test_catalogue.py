"""Every registered query of the engine's own operators against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from loomframe.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"generate_orders_quality"}))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_faithful(spark, sf):
    scores = {r["dimension"]: r["score"] for r in catalogue.flagship(spark, sf).collect()}
    assert scores["fidelity"] > 90 and scores["uniqueness"] == 100 and scores["privacy"] is None and scores["overall"] > 90
