"""One table from specs to a checked result: generate, protect, take the types that this leaves, repair rules, report."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from . import generate as G
from . import privacy, redraw, rules, validate
from .infer import ColumnSpec


def effective(specs: list[ColumnSpec]) -> list[ColumnSpec]:
    """The specs of protected columns: masked and hashed ones hold text, noisy ones decimal numbers."""
    types = {"mask": "string", "hash": "string", "noise": "float"}
    return [replace(s, type=types.get(s.transform, s.type), unique=s.unique and s.transform != "mask") for s in specs]


def drawn(
    spark: SparkSession, specs: list[ColumnSpec], n: int, seed: int, profile: G.Profile | None = None, config: G.Config = G.Config(), base: DataFrame | None = None, given: dict[str, Column] | None = None,  # noqa: B008
    forbidden: dict[str, DataFrame] | None = None, log: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The cells with forbidden values and repeats drawn anew, near-duplicate rows and injections; and the log of redraws.

    `forbidden` has a one-column table for each column whose values must not be given out; `log`, from an earlier run, stands for it.
    """
    given = given or {}
    made, logs = G.cells(spark, specs, n, seed, profile, config, base, given), []
    free = [s for s in specs if s.name not in given and not G.is_key(s)]
    for s in free:
        draws = G.redrawn(s, seed, profile, config, redraw.DRAWS)
        if forbidden and s.name in forbidden:
            made, own = redraw.avoid(made, s.name, forbidden[s.name], draws, seed)
            logs.append(own)
        elif log is not None:
            made = redraw.replay(made, s.name, log, draws, seed)
    for s in free:
        # An unforced unique e-mail has its row id in it.
        if s.unique and not (s.type == "email" and not forbidden and log is None):
            made = redraw.make_unique(made, s.name, G.redrawn(s, seed, profile, config, redraw.REDRAWN, redraw.DRAWS + 1), n)
    made = G.inject(made, [s for s in specs if s.name not in given], seed, profile, config)
    if config.duplicate_rate:
        made = redraw.near_duplicates(made, [s.name for s in free if not s.unique], seed, config.duplicate_rate).drop("_copied")
    return made, reduce(DataFrame.unionByName, logs) if logs else log


def build(
    spark: SparkSession, specs: list[ColumnSpec], n: int, seed: int, profile: G.Profile | None = None, config: G.Config = G.Config(), rule_list: tuple[rules.Rule, ...] = (), epsilon: float = 1.0, **options,  # noqa: B008
) -> tuple[DataFrame, list[ColumnSpec]]:
    """n rows (_rid and the columns) and their effective specs. Rules come last, so nothing after them can break them."""
    made, _ = drawn(spark, specs, n, seed, profile, config, **options)
    return finished(made, specs, seed, profile, rule_list, epsilon), effective(specs)


def finished(made: DataFrame, specs: list[ColumnSpec], seed: int, profile: G.Profile | None = None, rule_list: tuple[rules.Rule, ...] = (), epsilon: float = 1.0) -> DataFrame:
    """Protected and with its rules repaired: _rid and the columns, without flags."""
    ranges = {s.name: (p.quantiles[0], p.quantiles[-1]) for s in specs if profile and (p := profile.columns.get(s.name)) and p.quantiles}
    plain = made.select("_rid", *[f"`{s.name}`" for s in specs])
    safe = privacy.protect(plain, {s.name: s.transform for s in specs}, "_rid", seed, {s.name: s.semantic for s in specs}, ranges, epsilon)
    return rules.enforce(safe, list(rule_list), "_rid", seed)


def checked(spark: SparkSession, specs: list[ColumnSpec], n: int, seed: int, original: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The table, kept for the checks that all read it (unpersist it when done), and the report on it."""
    made, now = build(spark, specs, n, seed, G.learn(original, specs) if original is not None else None, **options)
    made = made.persist()
    return made, validate.report(made.drop("_rid"), now, n, original, options.get("rule_list", ()))
