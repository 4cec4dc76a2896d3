"""CSV and JSON files as text tables: delimiter, header, ragged rows, wrappers, key order, missing cells."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell

DELIMITERS = (",", "\t", ";", "|")
SNIFF = 20


class ReadError(ValueError):
    pass


def header_names(names: list[str]) -> list[str]:
    """Byte-order mark and outer spaces off; an empty name becomes column_<n>; a repeated one gets a number."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = (n or "").lstrip("﻿").strip() or f"column_{i + 1}"
        k, base = 2, n
        while n in out:
            n, k = f"{base}_{k}", k + 1
        out.append(n)
    return out


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that all first lines have most evenly."""
    def fit(d: str) -> tuple[int, int]:
        counts = [x.count(d) for x in lines]
        return (min(counts), -(max(counts) - min(counts))) if counts else (0, 0)

    best = max(DELIMITERS, key=fit)
    return best if fit(best)[0] else ","


def normalised(df: DataFrame) -> DataFrame:
    """All cells as trimmed text, missing tokens as null; arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[cell(F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


@dataclass(frozen=True)
class CsvReport:
    """Rows read, those with another number of fields than the header, the line of the first of these (rows counted from 2), and what to tell the user."""

    n_rows: int
    n_bad: int
    first_bad: int | None
    warnings: tuple[str, ...]


def read_csv_report(spark: SparkSession, path: str) -> tuple[DataFrame, CsvReport]:
    """A CSV file with a header, and what did not fit. More than half of the rows with a wrong number of fields is an error that names the first
    of them; fewer are padded or cut. Rows of empty cells are left out and not counted."""
    first = [r[0] for r in spark.read.text(path).limit(SNIFF).collect()]  # a fixed number of lines
    if not first:
        raise ReadError("the file is empty")
    if any("\0" in x for x in first):
        raise ReadError("the file is binary")
    filled = [x for x in first if x.strip()]
    if not filled:
        raise ReadError("the file has no columns")
    sep = sniff_delimiter(filled)
    names, bad = header_names(next(csv.reader(filled[:1], delimiter=sep))), "_corrupt_record"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(bad, T.StringType())])
    read = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(schema).csv(path)
    some = F.coalesce(*[F.when(F.trim(F.col(f"`{n}`")) != "", F.lit(1)) for n in names])
    rows = read.withColumn("_at", F.monotonically_increasing_id()).where(some.isNotNull())
    counts = rows.agg(F.count("*").alias("n"), F.count(bad).alias("bad"), F.min(F.when(F.col(bad).isNotNull(), F.col("_at"))).alias("at")).first()
    n, wrong, line, said = counts["n"], counts["bad"], None, ()
    if wrong:
        line = rows.where(F.col("_at") < counts["at"]).count() + 2
        if wrong * 2 > n:
            raise ReadError(f"{wrong} of {n} rows do not fit the header, the first at line {line}")
        said = (f"{wrong} of {n} rows did not fit the header, the first at line {line}: missing fields are empty, further ones are left out",)
    return normalised(rows.drop(bad, "_at")), CsvReport(n, wrong, line, said)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_report(spark, path)[0]


def json_records(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(at, record): the text of each record in order: of a line each, or, where lines are no objects, of the items of the file's array (`name` in its object)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("record")).where(F.trim("record") != "")
    if name is None and lines.where(F.json_object_keys("record").isNull()).isEmpty():
        return lines
    whole = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("_f"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    items = F.from_json("value", "array<string>") if name is None else F.from_json(F.element_at(F.from_json("value", "map<string,string>"), name), "array<string>")
    return whole.select("_f", F.posexplode(items).alias("_k", "record")).select((F.shiftleft("_f", 20) + F.col("_k")).alias("at"), "record")


def key_order(records: DataFrame, columns: list[str]) -> list[str]:
    """Columns by first appearance among the keys of all records; a record that is no object is an error that names the first one."""
    wrong = records.where(F.json_object_keys("record").isNull()).agg(F.min("at").alias("at")).first()["at"]
    if wrong is not None:
        raise ReadError(f"item {records.where(F.col('at') < wrong).count() + 1} is not an object")
    keys = records.select("at", F.posexplode(F.json_object_keys("record")).alias("k", "key"))
    seen = [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct("at", "k")).alias("first")).orderBy("first").collect()]  # a row a column
    return [*[c for c in seen if c in columns], *[c for c in columns if c not in seen]]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, an array of objects, or an object with exactly one array of objects; columns in the order their keys first appear."""
    text = {"primitivesAsString": True, "mode": "PERMISSIVE"}
    ordered = lambda df, records: normalised(df.select(*[f"`{c}`" for c in key_order(records, df.columns)]))
    lines = spark.read.options(**text).json(path)
    if "_corrupt_record" not in lines.columns and len(lines.columns) and not _arrays(lines):
        return ordered(lines, json_records(spark, path))
    whole = spark.read.options(**text).option("multiLine", True).json(path)
    if "_corrupt_record" in whole.columns:
        items = json_records(spark, path)
        if not items.isEmpty():
            key_order(items, [])  # names an item that is no object
        raise ReadError("the file is not JSON")
    if len(arrays := _arrays(whole)) == 1:
        return ordered(whole.select(F.inline(f"`{arrays[0]}`")), json_records(spark, path, arrays[0]))
    if len(arrays) > 1:
        raise ReadError(f"several arrays of records: {', '.join(arrays)}")
    return ordered(whole, json_records(spark, path)) if spark.read.text(path).limit(1).where("value LIKE '[%'").count() else normalised(whole)


def _arrays(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: json, ndjson, jsonl; csv, tsv, txt or none; parquet."""
    kind = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("json", "ndjson", "jsonl"):
        return read_json(spark, path)
    if kind in ("csv", "tsv", "txt", ""):
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ReadError(f"unknown kind of file: {kind}")
