"""Linked tables: foreign keys found and verified, children generated for parents, totals kept in step."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.permute import permuted
from ..functions.stats import round_half_up
from .infer import ColumnSpec, normal_name


@dataclass(frozen=True)
class Relationship:
    parent: str
    parent_column: str
    child: str
    child_column: str
    low: int | None = 0
    high: int | None = 5
    cardinality: str = "1:N"


def generation_order(tables: list[str], links: list[Relationship]) -> list[str]:
    """Parents before children; a cycle or self-reference is an error that names the tables on it."""
    sorter = TopologicalSorter({t: [] for t in tables})
    for x in links:
        if x.parent == x.child:
            raise ValueError(f"{x.parent} refers to itself")
        sorter.add(x.child, x.parent)
    try:
        return list(sorter.static_order())
    except CycleError as e:
        raise ValueError(" -> ".join(e.args[1])) from None


def inclusions(children: dict[str, tuple[DataFrame, str]], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(child, parent, n_values, n_missing): for each pair of columns how many distinct child values the parent lacks.

    All columns are put under each other once; a value's row lists the columns that hold it, so one shuffle serves all pairs.
    """
    side = lambda found, label: [d.select(F.lit(n).alias("col"), F.lit(label).alias("side"), F.col(c).cast("string").alias("v")) for n, (d, c) in found.items()]
    each = reduce(DataFrame.unionAll, [*side(children, "c"), *side(parents, "p")]).where("v IS NOT NULL").distinct()
    held = each.groupBy("v").agg(F.collect_set(F.when(F.col("side") == "c", F.col("col"))).alias("cs"), F.collect_set(F.when(F.col("side") == "p", F.col("col"))).alias("ps"))
    names = F.array(*[F.lit(p) for p in parents])
    pairs = held.select(F.explode("cs").alias("child"), "ps").select("child", F.explode(F.transform(names, lambda p: F.struct(p.alias("parent"), (~F.array_contains(F.col("ps"), p)).cast("long").alias("miss")))).alias("x"))
    return pairs.groupBy("child", F.col("x.parent").alias("parent")).agg(F.count("*").alias("n_values"), F.sum("x.miss").alias("n_missing"))


_ID_LIKE = re.compile(r"(id|_key|_code|_no|_number|_ref)$")


def _owner(table: str) -> str:
    """A table's name in the singular."""
    n = normal_name(table)
    if n.endswith("ies"):
        return n[:-3] + "y"
    return n[:-2] if re.search(r"(ss|x|ch|sh|(?<![ao])us)es$", n) else n.removesuffix("s")


def _named_after(column: str, table: str, key: str) -> bool:
    """Whether a column's name points at a table's key: customer_id at customers.customer_id or customers.id."""
    c, k, owner = normal_name(column), normal_name(key), _owner(table)
    return c == f"{owner}_{k}" or (c == k and k.startswith(owner))


def detect(tables: dict[str, DataFrame], specs: dict[str, list[ColumnSpec]]) -> list[Relationship]:
    """Foreign keys: for each column the best unique column of another table.

    A column that looks like an identifier and whose values all stand in the other column scores 2, a name that points there 1. All
    candidates are compared in one pass (`inclusions`); only one link of a child table keeps its numbers of children.
    """
    parents = {(t, s.name): (tables[t], s.name) for t, own in specs.items() for s in own if s.unique}
    like = {(t, s.name): bool(_ID_LIKE.search(normal_name(s.name))) or s.semantic == "Identifier" for t, own in specs.items() for s in own}
    named = lambda c, p: _named_after(c[1], *p)
    children = {c: (tables[c[0]], c[1]) for c, is_id in like.items() if is_id or any(named(c, p) for p in parents if p[0] != c[0])}
    if not children or not parents:
        return []
    text = ".".join
    found = {(r["child"], r["parent"]): (r["n_values"], r["n_missing"]) for r in inclusions({text(c): x for c, x in children.items()}, {text(p): x for p, x in parents.items()}).collect()}  # pairs of columns
    out, driven = [], set()
    for c in children:
        best, score = None, 0
        for p in parents:
            n, missing = found.get((text(c), text(p)), (0, 0))
            inside = n > 0 and missing == 0
            if p[0] != c[0] and n and (mine := (2 if inside and like[c] else 0) + named(c, p)) > score:
                best, score, contained = p, mine, inside
        if best is None:
            continue
        stats = children_stats(tables[best[0]], best[1], tables[c[0]], c[1]).first()
        single = c in parents or (stats["max_children"] or 0) <= 1
        counted = contained and not single and c[0] not in driven
        if counted:
            driven.add(c[0])
        out.append(Relationship(*best, *c, stats["min_children"] if counted else None, stats["max_children"] if counted else None, "1:1" if single else "1:N"))
    return out


def children_stats(parent: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    """One row: parents, parents without children, least and most children."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return parent.select(F.col(key).alias("_k")).where("_k IS NOT NULL").join(counts, "_k", "left").agg(F.count("*").alias("n_parents"), F.sum((n == 0).cast("long")).alias("n_childless"), F.min(n).alias("min_children"), F.max(n).alias("max_children"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: n_fk non-null keys, n_null, n_orphans."""
    keys = parent.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_here", F.lit(1))
    joined = child.select(F.col(fk).alias("_k")).join(keys, "_k", "left")
    some = F.col("_k").isNotNull()
    return joined.agg(F.sum(some.cast("long")).alias("n_fk"), F.sum((~some).cast("long")).alias("n_null"), F.sum((some & F.col("_here").isNull()).cast("long")).alias("n_orphans"))


def link_report(tables: dict[str, DataFrame], links: list[Relationship]) -> DataFrame:
    """A row for each link (named `child.column -> parent.column`): keys, null ones and orphans, parents without children, least and most children,
    parents with fewer or more than the link allows, its status and its integrity in percent. One shuffle a link: children are counted by
    key before they meet the parents.
    """
    def one(x: Relationship) -> DataFrame:
        keys = tables[x.parent].select(F.col(f"`{x.parent_column}`").cast("string").alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_p", F.lit(True))
        counts = tables[x.child].select(F.col(f"`{x.child_column}`").cast("string").alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
        both = counts.join(keys, "_k", "full").withColumn("_n", F.coalesce("_n", F.lit(0)))
        here, n, null = F.coalesce("_p", F.lit(False)), F.col("_n"), F.col("_k").isNull()
        low, high = (x.low or 0, x.high) if x.cardinality != "1:1" else (0, 1)
        total = lambda test, what=n: F.coalesce(F.sum(F.when(test, what)), F.lit(0)).cast("long")
        one_ = F.lit(1)
        facts = both.agg(
            total(~null).alias("n_fk"), total(null).alias("n_null"), total(~null & ~here).alias("n_orphans"), total(here & (n == 0), one_).alias("n_childless"), F.min(F.when(here, n)).alias("min_children"), F.max(F.when(here, n)).alias("max_children"),
            total(here & (n < low), one_).alias("n_under"), (total(here & (n > high), one_) if high is not None else F.lit(0).cast("long")).alias("n_over"),
        )
        off = F.col("n_under") + F.col("n_over")
        status = F.when(F.col("n_orphans") > 0, "failed").when((off > 0) | (F.col("n_null") > 0), "warning").otherwise("passed")
        score = round_half_up(100.0 * (F.col("n_fk") - F.col("n_orphans")) / F.nullif(F.col("n_fk") + F.col("n_null"), F.lit(0)), 1)
        return facts.select(F.lit(f"{x.child}.{x.child_column} -> {x.parent}.{x.parent_column}").alias("link"), *facts.columns, status.alias("status"), score.alias("integrity"))

    return reduce(DataFrame.unionByName, [one(x) for x in links])


def pair_duplicates(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_extra"))


def rule_values(parent: DataFrame, key: str, child: DataFrame, fk: str, term: Column, how: str = "sum", digits: int = 2) -> DataFrame:
    """(key, value): an aggregate of a term over each parent's children; rows with a null term are skipped; childless: sum and count 0, others null."""
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    found = child.select(F.col(fk).alias(key), term.alias("_t")).where("_t IS NOT NULL").groupBy(key).agg(agg("_t").cast("double").alias("_v"))
    value = round_half_up(F.coalesce("_v", F.lit(0.0)) if how in ("sum", "count") else F.col("_v"), digits)
    return parent.select(key).join(found, key, "left").select(key, value.alias("value"))


def reconcile(parent: DataFrame, key: str, stored: str, values: DataFrame) -> DataFrame:
    """One row: parents and those whose stored value is not the rule's."""
    off = F.abs(F.col(stored) - F.col("value")) > 0.01 + 1e-9 * F.abs("value")
    return parent.join(values, key).agg(F.count("*").alias("n_parents"), F.sum(F.coalesce(off, F.col(stored).isNull() != F.col("value").isNull()).cast("long")).alias("n_off"))


def children_of(parent: DataFrame, key: str, low: int, high: int, seed: int, name: str) -> DataFrame:
    """(fk, _k): between low and high children for each parent row, numbered from 0."""
    n = rng.integer(rng.uniform(seed, f"children:{name}", F.col(key)), low, high)
    return parent.select(F.col(key).alias("fk"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("_k"))


def random_parents(child: DataFrame, rid: str, fk: str, parent: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """The child rows with a parent's key in `fk`, each parent equally likely; parents are numbered in the order of their keys."""
    numbered = number_rows(parent.select(F.col(key).alias(fk)), [fk])
    n = parent.count()
    at = F.least(F.floor(rng.uniform(seed, f"parent:{name}", F.col(rid)) * n), F.lit(n - 1)).cast("long")
    return child.withColumn("_rid", at).join(numbered, "_rid").drop("_rid")


def fill(child: DataFrame, fk: str, links: DataFrame, rid: str = "_rid") -> DataFrame:
    """The child rows with the key of the parent that `links` (rid, fk) assigns to them."""
    return child.drop(fk).join(links.select(rid, fk), rid)


def coerced(specs: dict[str, list[ColumnSpec]], links: list[Relationship]) -> dict[str, list[ColumnSpec]]:
    """The specs that links ask for: parents' keys unique and never null, foreign keys never null, and unique if 1:1."""
    keys = {(x.parent, x.parent_column) for x in links}
    single = {(x.child, x.child_column): x.cardinality == "1:1" for x in links}

    def one(t: str, s: ColumnSpec) -> ColumnSpec:
        if (t, s.name) in keys:
            return replace(s, unique=True, nullable=False)
        return replace(s, unique=single[t, s.name], nullable=False) if (t, s.name) in single else s

    return {t: [one(t, s) for s in own] for t, own in specs.items()}


@dataclass(frozen=True)
class Total:
    """A parent's column that aggregates a term (a SQL expression) over its children."""

    link: Relationship
    column: str
    term: str
    how: str = "sum"


def apply_totals(tables: dict[str, DataFrame], totals: list[Total]) -> dict[str, DataFrame]:
    """Write the totals' columns, deepest children first, so that totals of totals agree."""
    order = generation_order(list(tables), [t.link for t in totals])
    out = dict(tables)
    for t in sorted(totals, key=lambda t: -order.index(t.link.parent)):
        x = t.link
        values = rule_values(out[x.parent], x.parent_column, out[x.child], x.child_column, F.expr(t.term), t.how).withColumnRenamed("value", t.column)
        out[x.parent] = out[x.parent].drop(t.column).join(values, x.parent_column)
    return out


def one_to_one(parent: DataFrame, key: str, n: int, seed: int, name: str) -> DataFrame:
    """(fk): n different parents, those of the smallest draws."""
    return parent.select(F.col(key).alias("fk"), rng.uniform(seed, f"one:{name}", F.col(key)).alias("_u")).orderBy("_u", "fk").limit(n).select("fk")


def many_to_many(left: DataFrame, left_key: str, n_right: int, low: int, high: int, seed: int, name: str) -> DataFrame:
    """(a, b): for each left row between low and high different right rows numbered 0 to n_right - 1, drawn without replacement."""
    a = F.col(left_key)
    n = F.least(rng.integer(rng.uniform(seed, f"links:{name}", a), low, high), F.lit(n_right))
    each = left.select(a.alias("a"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("_k"))
    return each.select("a", permuted(F.col("_k"), n_right, seed, f"partner:{name}", F.col("a")).alias("b"))


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `_rid`, gapless from 0 in the given order: rows are sorted by range, and each range starts after the ones before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").select((F.col("_b") + within).alias("_rid"), *df.columns)


def expand_many_to_many(specs: dict[str, list[ColumnSpec]], links: list[Relationship]) -> tuple[dict[str, list[ColumnSpec]], list[Relationship], dict[str, tuple[Relationship, Relationship]]]:
    """Each N:N link as a table of pairs with a link to either side; and these tables' two links."""
    specs, out, joins = dict(specs), [], {}
    for x in links:
        if x.cardinality != "N:N":
            out.append(x)
            continue
        name, k = f"{x.parent}_{x.child}", 2
        while name in specs:
            name, k = f"{x.parent}_{x.child}_{k}", k + 1
        ends = [(x.parent, x.parent_column), (x.child, x.child_column)]
        columns = [f"{_owner(t)}_{normal_name(c)}" if not normal_name(c).startswith(_owner(t)) else normal_name(c) for t, c in ends]
        if columns[0] == columns[1]:
            columns[1] += "_2"
        types = [next((s.type for s in specs.get(t, []) if s.name == c), "integer") for t, c in ends]
        specs[name] = [ColumnSpec(c, t, "Identifier", "identifier", False) for c, t in zip(columns, types, strict=True)]
        pair = Relationship(*ends[0], name, columns[0], x.low, x.high), Relationship(*ends[1], name, columns[1], None, None)
        joins[name] = pair
        out += pair
    return specs, out, joins


def design_problems(specs: dict[str, list[ColumnSpec]], links: list[Relationship], totals: list[Total] = ()) -> list[str]:
    """What keeps a design of linked tables from being generated, in words; empty if nothing does."""
    found = [] if specs else ["there is no table"]
    number = ("integer", "float")
    types = {(t, s.name): s.type for t, columns in specs.items() for s in columns}
    for t, columns in specs.items():
        names = [s.name.strip() for s in columns]
        found += [f"{t or 'a table'} has no name"] * (not t.strip()) + [f"{t} has no columns"] * (not columns) + [f"{t} has a column without a name"] * ("" in names)
        found += [f"{t} has the column {n} more than once" for n in sorted({n for n in names if n and names.count(n) > 1})]
    for x in links:
        found += [f"{t}.{c} does not exist" for t, c in ((x.parent, x.parent_column), (x.child, x.child_column)) if (t, c) not in types]
        if x.low is not None and x.high is not None and x.low > x.high:
            found.append(f"{x.parent} -> {x.child}: at least {x.low} but at most {x.high} children")
    drivers = [x.child for x in links if x.cardinality != "N:N" and x.high is not None]
    found += [f"{t}: {drivers.count(t)} links set its number of rows" for t in sorted(set(drivers)) if drivers.count(t) > 1]
    for r in totals:
        parent, child = r.link.parent, r.link.child
        kind = types.get((parent, r.column))
        found += [f"{parent}.{r.column} " + ("does not exist" if kind is None else "is not a number")] * (kind not in number)
        if not any((x.parent, x.child) == (parent, child) and x.cardinality != "N:N" for x in links):
            found.append(f"no link from {child} to {parent} for {parent}.{r.column}")
    if not found:
        try:
            wide, direct, _ = expand_many_to_many(specs, links)
            generation_order(list(wide), direct)
        except ValueError as e:
            found.append(f"the links go round in a circle: {e}")
    return found


def estimate_rows(rows: dict[str, int], links: list[Relationship]) -> dict[str, int]:
    """How many rows each table will have: of its parent's rows and the mean number of children, or as asked for."""
    specs: dict[str, list[ColumnSpec]] = {t: [] for t in rows}
    wide, direct, joins = expand_many_to_many(specs, links)
    out: dict[str, int] = {}
    for t in generation_order(list(wide), direct):
        incoming = [x for x in direct if x.child == t]
        one = next((x for x in incoming if x.cardinality == "1:1"), None)
        drive = next((x for x in incoming if x.cardinality == "1:N" and x.high is not None), None)
        if t in joins:
            first = joins[t][0]
            low = 1 if first.low is None else first.low
            out[t] = round(out[first.parent] * (low + (max(low, 3) if first.high is None else first.high)) / 2)
        elif one:
            out[t] = min(rows.get(t, out[one.parent]), out[one.parent])
        elif drive:
            out[t] = round(out[drive.parent] * ((drive.low or 0) + drive.high) / 2)
        else:
            out[t] = rows.get(t, 0)
    return out
