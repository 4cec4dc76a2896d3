"""CSV, JSON and SQL exports, rendered as text columns and written in parallel; sizes without writing."""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, sql_literal

INSERT_ROWS = 500
_UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def slug(text: str) -> str:
    plain = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:60] or "export"


def file_name(name: str, extension: str, day: date) -> str:
    return f"{slug(name)}_{day.isoformat()}.{extension}"


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CRLF line ends, quoting and formula guard; each part file starts with a header."""
    df.select(*[csv_field(F.col(f"`{c}`")).alias(c) for c in df.columns]).select(F.concat_ws(",", *[F.col(f"`{c}`") for c in df.columns]).alias(",".join(df.columns))).write.option("lineSep", "\r\n").text(path)


def csv_size(df: DataFrame) -> DataFrame:
    """One row: bytes of the CSV with LF line ends, header included, without guard: what fields, quotes and separators take."""
    header = len(",".join(df.columns).encode()) + 1

    def field(c: str) -> Column:
        x = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quotes = F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))
        return F.octet_length(x) + F.when(x.rlike('[",\r\n]'), quotes + 2).otherwise(0)

    total = F.lit(len(df.columns))
    for c in df.columns:
        total = total + field(c)
    return df.agg((F.coalesce(F.sum(total), F.lit(0)) + header).alias("n_bytes"))


def json_line(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def sql_kind(name: str) -> str:
    return "integer" if name in ("bigint", "int", "smallint", "tinyint") else "float" if name in ("double", "float") or name.startswith("decimal") else "boolean" if name == "boolean" else "date" if name == "date" else "datetime" if name.startswith("timestamp") else "string"


def sql_columns(df: DataFrame) -> DataFrame:
    """(column, sql_type, not_null): types from the longest text and whether a null was seen, in one aggregation."""
    decimals = lambda c: F.length(F.rtrim(F.substring_index(F.format_number(F.abs(F.col(f"`{c}`")), 6), ".", -1), F.lit("0")))
    scale = lambda c, kind: F.max(decimals(c)) if sql_kind(kind) == "float" else F.lit(0)
    facts = df.agg(*[F.struct(scale(c, k).alias("scale"), F.max(F.length(F.col(f"`{c}`").cast("string"))).alias("len"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("nulls"), F.coalesce(F.bool_and(F.col(f"`{c}`").cast("string").rlike(_UUID)), F.lit(False)).alias("uuid")).alias(f"_{i}") for i, (c, k) in enumerate(df.dtypes)])
    rows = []
    for i, (c, kind) in enumerate(df.dtypes):
        fixed = {"integer": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP"}.get(sql_kind(kind))
        n = F.coalesce(F.col(f"_{i}.len"), F.lit(1))
        size = F.greatest(F.lit(16), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int"))
        rows.append(F.struct(F.lit(c).alias("column"), (F.lit(fixed) if fixed else F.concat(F.lit("NUMERIC(20,"), F.greatest(F.lit(2), F.coalesce(f"_{i}.scale", F.lit(0))).cast("string"), F.lit(")")) if sql_kind(kind) == "float" else F.when(F.col(f"_{i}.uuid"), "CHAR(36)").when(n > 1000, "TEXT").otherwise(F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")")))).alias("sql_type"), (F.col(f"_{i}.nulls") == 0).alias("not_null")))
    return facts.select(F.inline(F.array(*rows)))


def sql_inserts(df: DataFrame, table: str, rid: str) -> DataFrame:
    """(batch, statement): INSERT statements of 500 rows each, numbered by a gapless row id."""
    columns = [c for c in df.columns if c != rid]
    kinds = dict(df.dtypes)
    row = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(f"`{c}`"), sql_kind(kinds[c])) for c in columns]), F.lit(")"))
    batches = df.select(F.floor(F.col(rid) / INSERT_ROWS).alias("batch"), F.struct(F.col(rid).alias("i"), row.alias("row")).alias("x")).groupBy("batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    names = ", ".join(f'"{c}"' for c in columns)
    return batches.select("batch", F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES\n'), F.array_join(F.transform("x", lambda x: x["row"]), ",\n"), F.lit(";")).alias("statement"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_create(df: DataFrame, table: str, key: str | None = None, foreign: dict[str, tuple[str, str]] | None = None, unique: tuple[str, ...] = ()) -> DataFrame:
    """(table, statement): CREATE TABLE with types, NOT NULL where no null was seen, the key, unique columns and links to parents."""
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    name = F.concat(F.lit('"'), F.replace("column", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.lit("  "), name, F.lit(" "), "sql_type", F.when(F.col("not_null"), " NOT NULL").otherwise(""))
    lines = sql_columns(df).agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), line.alias("line")))).alias("x"))  # a row for each column
    extra = [f"  PRIMARY KEY ({_quoted(key)})"] if key else []
    extra += [f"  UNIQUE ({_quoted(c)})" for c in unique] + [f"  FOREIGN KEY ({_quoted(c)}) REFERENCES {_quoted(t)} ({_quoted(k)})" for c, (t, k) in (foreign or {}).items()]
    body = F.array_join(F.concat(F.transform("x", lambda x: x["line"]), F.array(*[F.lit(e) for e in extra]).cast("array<string>")), ",\n")
    return lines.select(F.lit(table).alias("table"), F.concat(F.lit(f"CREATE TABLE {_quoted(table)} (\n"), body, F.lit("\n);")).alias("statement"))


def relational_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(position, table, value): each row of each table as JSON, tables in the order given (parents first); write partitioned by table."""
    return reduce(DataFrame.unionByName, [json_line(df).select(F.lit(i).alias("position"), F.lit(t).alias("table"), "value") for i, (t, df) in enumerate(tables.items())])
