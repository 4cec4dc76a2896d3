"""Business rules: checks in one aggregation, repair in one projection, and text drawn from a pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from re import _constants as RE  # the standard parser's names
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng


@dataclass(frozen=True)
class Rule:
    """kind: range (low, high), allowed (values), pattern (pattern), compare (op, other)."""

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    pattern: str = ""
    op: str = "<="
    other: str = ""


_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "!=": Column.__ne__}


def holds(rule: Rule) -> Column:
    """Whether a row keeps the rule; nulls do."""
    c = F.col(f"`{rule.column}`")
    if rule.kind == "range":
        low = c >= rule.low if rule.low is not None else F.lit(True)
        test = low & (c <= rule.high) if rule.high is not None else low
    elif rule.kind == "allowed":
        test = c.isin(*rule.values)
    elif rule.kind == "pattern":
        test = c.cast("string").rlike(f"^(?:{rule.pattern})$")
    else:
        test = _OPS[rule.op](c, F.col(f"`{rule.other}`"))
    return F.coalesce(test, F.lit(True))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: n_rows, v0, v1, ... violations of each rule, n_passing rows that keep all."""
    whole = F.lit(True)
    for r in rules:
        whole = whole & holds(r)
    return df.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum((~holds(r)).cast("long")), F.lit(0)).alias(f"v{i}") for i, r in enumerate(rules)], F.coalesce(F.sum(whole.cast("long")), F.lit(0)).alias("n_passing"))


def enforce(df: DataFrame, rules: list[Rule], rid: str, seed: int = 1, passes: int = 3, step: float = 1.0) -> DataFrame:
    """Repair what breaks a rule. Rules that share a column can undo each other, so then all are run `passes` times."""
    touched = [c for r in rules for c in {r.column, *([r.other] if r.kind == "compare" else [])}]
    passes = passes if len(set(touched)) < len(touched) else 1
    for turn in range(passes):
        for i, r in enumerate(rules):
            c, bad, u = F.col(f"`{r.column}`"), ~holds(r), rng.uniform(seed, f"rule{i}", F.col(rid), turn)
            kind = dict(df.dtypes)[r.column]
            if r.kind == "range":
                low = r.low if r.low is not None else r.high - 0.1 * abs(r.high or 1)
                high = r.high if r.high is not None else low + 0.1 * abs(low or 1)
                draw = F.floor(u * (high - low + 1)) + low if kind in ("int", "bigint") else u * (high - low) + low
                df = df.withColumn(r.column, F.when(bad, draw.cast(kind)).otherwise(c))
            elif r.kind == "allowed":
                df = df.withColumn(r.column, F.when(bad, rng.pick(u, list(r.values)).cast(kind)).otherwise(c))
            elif r.kind == "pattern":
                df = df.withColumn(r.column, F.when(bad, from_pattern(r.pattern, seed, f"rule{i}:{turn}", F.col(rid))).otherwise(c))
            else:
                other = F.col(f"`{r.other}`")
                swapped = _OPS[r.op](other, c)
                moved = c + (step if r.op in ("<", "<=", "!=") else -step)
                df = df.withColumns({r.column: F.when(bad & swapped, other).otherwise(c), r.other: F.when(bad & swapped, c).when(bad, moved.cast(dict(df.dtypes)[r.other])).otherwise(other)})
    return df


def from_pattern(pattern: str, seed: int, stream: str, rid: Column) -> Column:
    """Text that matches a regular expression of literals, classes, groups, alternatives and quantifiers, as one Column."""
    drawn = iter(range(1 << 30))

    def draw() -> Column:
        return rng.uniform(seed, stream, rid, next(drawn))

    def characters(items) -> str:
        out = ""
        for op, value in items:
            if op is RE.LITERAL:
                out += chr(value)
            elif op is RE.RANGE:
                out += "".join(map(chr, range(value[0], value[1] + 1)))
            elif op is RE.CATEGORY and value in (RE.CATEGORY_DIGIT, RE.CATEGORY_WORD, RE.CATEGORY_SPACE):
                out += {RE.CATEGORY_DIGIT: "0123456789", RE.CATEGORY_WORD: "abcdefghijklmnopqrstuvwxyz0123456789_", RE.CATEGORY_SPACE: " "}[value]
            else:
                raise ValueError(f"{op} is not supported in a pattern")
        return out

    def one(op, value) -> Column:
        if op is RE.LITERAL:
            return F.lit(chr(value))
        if op is RE.ANY:
            return rng.pick(draw(), list("abcdefghijklmnopqrstuvwxyz"))
        if op is RE.IN:
            return rng.pick(draw(), list(characters(value)))
        if op is RE.SUBPATTERN:
            return many(value[3])
        if op is RE.BRANCH:
            options, u = [many(v) for v in value[1]], draw()
            out = options[-1]
            for k in range(len(options) - 2, -1, -1):
                out = F.when(u < (k + 1) / len(options), options[k]).otherwise(out)
            return out
        if op is RE.MAX_REPEAT:
            low, high, inner = value
            high = min(high, low + 3)
            u = draw()
            return F.concat(*[many(inner) if k < low else F.when(F.floor(u * (high - low + 1)) > k - low, many(inner)).otherwise("") for k in range(high)], F.lit(""))
        if op is RE.AT:
            return F.lit("")
        raise ValueError(f"{op} is not supported in a pattern")

    def many(items) -> Column:
        return F.concat(*[one(op, value) for op, value in items], F.lit(""))

    return many(_parser.parse(pattern))


def describe(rule: Rule) -> str:
    """A rule in words."""
    if rule.kind == "range":
        ends = [f"at least {rule.low:g}"] * (rule.low is not None) + [f"at most {rule.high:g}"] * (rule.high is not None)
        return f"{rule.column} is {' and '.join(ends) or 'anything'}"
    if rule.kind == "allowed":
        return f"{rule.column} is one of {', '.join(map(str, rule.values))}"
    return f"{rule.column} matches {rule.pattern}" if rule.kind == "pattern" else f"{rule.column} {rule.op} {rule.other}"


def for_table(rules: list[Rule], table: str) -> list[Rule]:
    """The rules on `table.column`, with the table's name taken off."""
    bare = lambda c: c.removeprefix(f"{table}.")
    return [replace(r, column=bare(r.column), other=bare(r.other)) for r in rules if r.column.startswith(f"{table}.")]


def problem(rule: Rule, kinds: dict[str, str]) -> str | None:
    """Why a rule cannot be applied to columns of these kinds (integer, float, date, datetime, string, ...); None if it can."""
    ordered = ("integer", "float", "date", "datetime")
    for c in (rule.column, *([rule.other] if rule.kind == "compare" else [])):
        if c not in kinds:
            return f"{c} does not exist"
        if rule.kind in ("range", "compare") and kinds[c] not in ordered:
            return f"{c} is neither a number nor a date"
    if rule.kind == "range":
        if rule.low is None and rule.high is None:
            return f"{rule.column}: neither end is given"
        return f"{rule.column}: the low end is above the high end" if None not in (rule.low, rule.high) and rule.low > rule.high else None
    if rule.kind == "allowed":
        return None if rule.values else f"{rule.column}: no values are allowed"
    if rule.kind == "pattern":
        try:
            _parser.parse(rule.pattern)
        except re.error as e:
            return f"{rule.column}: {e}"
        return None
    if rule.op not in _OPS:
        return f"{rule.op} does not compare"
    dates = [kinds[c].startswith("date") for c in (rule.column, rule.other)]
    return f"{rule.column} compares with itself" if rule.column == rule.other else None if dates[0] == dates[1] else f"{rule.column} and {rule.other} are of different kinds"
