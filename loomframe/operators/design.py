"""A design of linked tables run from end to end: keys, links, cells, protection, rules and totals.

Every table's rows are numbered from 0, and a key is a function of its row's number. So a foreign key is worked out from the number of
the parent that was drawn, and no join fetches it; only keys that are drawn freely (a unique e-mail) are looked up by row number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.permute import permuted
from ..functions.stats import running_totals
from ..functions.stored import stored
from . import generate as G
from . import relational as R
from . import rules as rule_ops
from . import tabular
from .infer import ColumnSpec


@dataclass(frozen=True)
class Design:
    """Tables by name with their columns and, where no link sets it, their number of rows."""

    tables: dict[str, list[ColumnSpec]]
    rows: dict[str, int]
    links: tuple[R.Relationship, ...] = ()
    totals: tuple[R.Total, ...] = ()
    rules: dict[str, tuple[rule_ops.Rule, ...]] = field(default_factory=dict)


@dataclass
class Made:
    tables: dict[str, DataFrame]
    specs: dict[str, list[ColumnSpec]]
    links: list[R.Relationship]
    order: list[str]
    rows: dict[str, int]
    logs: dict[str, DataFrame]


def table_seed(seed: int, table: str) -> int:
    return rng.fnv1a(f"{seed}|{table}")


def children(spark: SparkSession, n_parents: int, low: int, high: int, seed: int, name: str) -> tuple[DataFrame, int]:
    """(_rid, _parent, _k): between low and high children for each of the parents 0 .. n_parents - 1, numbered without gaps; and how many.

    Parents' counts are summed up by ranges, and a parent's children start at the total before it.
    """
    counts = spark.range(n_parents).select(F.col("id").alias("_parent"), rng.integer(rng.uniform(seed, f"children:{name}", F.col("id")), low, high).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    upto = running_totals(counts, "_parent", ["_n"]).where("_n > 0")
    rows = upto.select("_parent", (F.col("_n_upto") - F.col("_n")).alias("_start"), F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_k"))
    return rows.select((F.col("_start") + F.col("_k")).cast("long").alias("_rid"), "_parent", F.col("_k").cast("long").alias("_k")), total


def pairs(spark: SparkSession, n_left: int, n_right: int, low: int, high: int, seed: int, name: str) -> tuple[DataFrame, int]:
    """(_rid, _a, _b): for each left row between low and high different right rows."""
    low, high = min(low, n_right), min(high, n_right)
    rows, total = children(spark, n_left, low, high, seed, name)
    if not n_right:
        return rows.select("_rid", F.col("_parent").alias("_a"), F.lit(0).cast("long").alias("_b")).limit(0), 0
    return rows.select("_rid", F.col("_parent").alias("_a"), permuted(F.col("_k"), n_right, seed, f"partner:{name}", F.col("_parent")).alias("_b")), total


def _base(spark: SparkSession, t: str, design: Design, incoming: list[R.Relationship], join: tuple | None, rows: dict[str, int], seed: int) -> tuple[DataFrame, int, dict[int, Column]]:
    """Row numbers of a table, how many there are, and each incoming link's parent number as an expression over them."""
    rid = F.col("_rid")
    if join:
        first, second = join
        low = 1 if first.low is None else first.low
        base, n = pairs(spark, rows[first.parent], rows[second.parent], low, max(low, 3) if first.high is None else max(low, first.high), seed, t)
        return base, n, {id(first): F.col("_a"), id(second): F.col("_b")}
    at: dict[int, Column] = {}
    one = next((x for x in incoming if x.cardinality == "1:1"), None)
    drive = next((x for x in incoming if x.cardinality == "1:N" and x.high is not None), None)
    if one:
        n = min(design.rows.get(t, rows[one.parent]), rows[one.parent])
        base = spark.range(n).select(F.col("id").alias("_rid"))
    elif drive:
        low = drive.low or 0
        base, n = children(spark, rows[drive.parent], low, max(low, drive.high), seed, t)
        at[id(drive)] = F.col("_parent")
    else:
        n = design.rows.get(t, 0)
    limit = min([n, *[rows[x.parent] for x in incoming if x.cardinality == "1:1"]])
    if limit < n or not (one or drive):
        base = base.where(rid < limit) if one or drive else spark.range(limit).select(F.col("id").alias("_rid"))
        n = limit
    for i, x in enumerate(incoming):
        if id(x) in at:
            continue
        m = rows[x.parent]
        if not m:
            at[id(x)] = F.lit(None).cast("long")
        elif x.cardinality == "1:1":
            at[id(x)] = permuted(rid, m, seed, f"one:{t}:{x.child_column}")
        else:
            at[id(x)] = rng.integer(rng.uniform(seed, f"parent:{t}:{x.child_column}", rid), 0, m - 1)
    return base, n, at


def run(
    spark: SparkSession, design: Design, seed: int, profiles: dict[str, G.Profile] | None = None, config: G.Config = G.Config(), epsilon: float = 1.0,  # noqa: B008
    forbidden: dict[str, dict[str, DataFrame]] | None = None, logs: dict[str, DataFrame] | None = None,
) -> Made:
    """All tables of a design, each with `_rid`: parents before children, and totals from the final children, the deepest first.

    Columns that links use keep their values whatever their transform, and no rule touches them. A null foreign key stands where a parent
    has no rows. `forbidden` and `logs` are those of tabular.drawn(), by table.
    """
    if problems := R.design_problems(design.tables, list(design.links), list(design.totals)):
        raise ValueError("; ".join(problems))
    wide, links, joins = R.expand_many_to_many(design.tables, list(design.links))
    specs = R.coerced(wide, links)
    linked = {(x.parent, x.parent_column) for x in links} | {(x.child, x.child_column) for x in links}
    specs = {t: [replace(s, transform="preserve") if (t, s.name) in linked else s for s in own] for t, own in specs.items()}
    order, profiles = R.generation_order(list(specs), links), profiles or {}
    out = Made({}, {}, links, order, {}, {})
    for t in order:
        own, incoming = table_seed(seed, t), [x for x in links if x.child == t]
        base, n, at = _base(spark, t, design, incoming, joins.get(t), out.rows, own)
        given: dict[str, Column] = {}
        for i, x in enumerate(incoming):
            s = next(s for s in specs[x.parent] if s.name == x.parent_column)
            if G.is_key(s):
                given[x.child_column] = G.key_value(s, _key_profile(profiles, x.parent, s.name), table_seed(seed, x.parent), at[id(x)])
            else:
                keys = out.tables[x.parent].select(F.col("_rid").alias(f"_r{i}"), F.col(f"`{x.parent_column}`").alias(f"_k{i}"))
                base = base.withColumn(f"_r{i}", at[id(x)]).join(keys, f"_r{i}", "left").drop(f"_r{i}")
                given[x.child_column] = F.col(f"_k{i}")
        made, log = tabular.drawn(spark, specs[t], n, own, profiles.get(t), config, base, given, (forbidden or {}).get(t), (logs or {}).get(t))
        mine = tuple(r for r in design.rules.get(t, ()) if (t, r.column) not in linked and (t, getattr(r, "other", None)) not in linked)
        # Written: children may look keys up, and totals read children's final values.
        out.tables[t] = stored(tabular.finished(made, specs[t], own, profiles.get(t), mine, epsilon), "table")
        out.specs[t], out.rows[t] = tabular.effective(specs[t]), n
        if log is not None:
            out.logs[t] = log
    totals = [replace(x, link=next(y for y in links if (y.parent, y.child) == (x.link.parent, x.link.child))) for x in design.totals]
    columns = {t: df.columns for t, df in out.tables.items()}
    out.tables = {t: df.select(*columns[t]) for t, df in R.apply_totals(out.tables, totals).items()}
    return out


def _key_profile(profiles: dict[str, G.Profile], table: str, column: str) -> G.ColumnProfile | None:
    return profiles[table].columns.get(column) if table in profiles else None
