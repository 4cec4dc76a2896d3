"""Cells that must be drawn anew: forbidden values, repeats in unique columns, and near-duplicate rows with small edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.stored import stored

#: Draws that a forbidden value and a repeat get, those of them that are looked up first, and suffixes that are looked up together.
DRAWS = 20
FIRST = 4
REDRAWN = 3
SUFFIXES = 12
LOG = "column string, _rid long, draws int, suffixes int"


def normal(c: Column) -> Column:
    """What two values are compared by: their text without outer white space, in lower case."""
    return F.lower(F.trim(c.cast("string")))


def suffixed(value: Column, kind: str, seed: int, column: str, steps: int, past: int = 0) -> Column:
    """An array of `steps` values further and further from `value`: a number grows by 1, a text gets one more drawn initial each time."""
    if kind not in ("string", "varchar"):
        return F.array(*[(value + past + k + 1).cast(kind) for k in range(steps)])
    letter = lambda k: F.chr(rng.integer(rng.uniform(seed, f"suffix:{column}", F.col("_rid"), k), 65, 90))
    tail = lambda k: F.concat(*[x for j in range(k + 1) for x in (F.lit(" "), letter(j), F.lit("."))])
    return F.array(*[F.concat(value, tail(past + k)) for k in range(steps)])


def avoid(df: DataFrame, column: str, forbidden: DataFrame, draws: list[Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with another value where `forbidden` (one column) holds theirs, and the log of what was done.

    `draws` are further draws as functions of `_rid`. A row that is hit takes its first free draw, or, if none is free, the last of them
    with the first free suffix, which is looked up as well. Only rows that are hit have candidates: the first few draws, then, for rows
    without a free one among them, the other draws, and suffixes, more and more of them, for rows that are still left. The log
    (column, _rid, draws, suffixes) holds no values, and replay() with it gives the same table without `forbidden`.
    """
    kind = dict(df.dtypes)[column]
    taken = stored(forbidden.select(normal(F.col(forbidden.columns[0])).alias("_v")).where("_v IS NOT NULL").distinct(), "taken")
    left = stored(df.withColumn("_v", normal(F.col(f"`{column}`"))).join(taken, "_v", "left_semi").select("_rid"), "hit")
    log, drawn, past = None, 0, 0
    while not left.isEmpty():
        upto = min(len(draws), drawn + FIRST) if not drawn else len(draws)
        if drawn < len(draws):
            candidates = F.array(*[d.cast(kind) for d in draws[drawn:upto]])
        else:
            candidates = suffixed(draws[-1], kind, seed, column, SUFFIXES, past)
        each = left.select("_rid", F.posexplode(candidates).alias("_k", "_c")).select("_rid", "_k", normal(F.col("_c")).alias("_v"))
        free = each.join(taken, "_v", "left_anti").groupBy("_rid").agg((F.min("_k") + 1).alias("_k"))
        steps = (F.col("_k") + drawn, F.lit(0)) if drawn < len(draws) else (F.lit(len(draws)), F.col("_k") + past)
        rows = stored(free.select(F.lit(column).alias("column"), "_rid", steps[0].cast("int").alias("draws"), steps[1].cast("int").alias("suffixes")), "log")
        log = rows if log is None else log.unionByName(rows)
        past = past if drawn < len(draws) else past + SUFFIXES
        left, drawn = stored(left.join(rows, "_rid", "left_anti"), "hit"), upto
    log = df.sparkSession.createDataFrame([], LOG) if log is None else log
    return replay(df, column, log, draws, seed), log


def replay(df: DataFrame, column: str, log: DataFrame, draws: list[Column], seed: int) -> DataFrame:
    """The rows with the redraws of a log made again."""
    kind = dict(df.dtypes)[column]
    own = log.where(F.col("column") == column).select("_rid", F.col("draws").alias("_d"), F.col("suffixes").alias("_s"))
    most, last = own.agg(F.max("_s"), F.max("_d")).first()
    if most is None:
        return df
    value = F.lit(None).cast(kind)
    for k in range(last, 0, -1):  # only the draw that the log names is made
        value = F.when(F.col("_d") == k, draws[k - 1].cast(kind)).otherwise(value)
    if most:
        value = F.when(F.col("_s") > 0, F.element_at(suffixed(draws[-1], kind, seed, column, most), F.greatest("_s", F.lit(1)))).otherwise(value)
    changed = F.when(F.col("_d").isNotNull(), value).otherwise(F.col(f"`{column}`"))
    return df.join(own, "_rid", "left").select(*[(changed if c == column else F.col(f"`{c}`")).alias(c) for c in df.columns])


def apart(value: Column, kind: str, k: Column, digits: int = 2) -> Column:
    """A value told apart by a number: `local.k@domain`, `text-k`, or a number moved by k (of its last digit)."""
    if kind in ("string", "varchar"):
        at = F.instr(value, "@")
        return F.when(at > 1, F.concat(F.substring(value, F.lit(1), at - 1), F.lit("."), k.cast("string"), F.substring(value, at, F.length(value)))).otherwise(F.concat_ws("-", value, k.cast("string")))
    if kind in ("double", "float"):
        return F.round(value + k * 10.0**-digits, 6).cast(kind)
    return (value + k).cast(kind)


def make_unique(df: DataFrame, column: str, draws: list[Column] | tuple = (), n: int | None = None) -> DataFrame:
    """No value of a column twice (nulls aside): repeats are drawn again, and told apart by their row id once draws run out.

    Each round counts the values, the row that has had its value for longest (then the smallest row id) keeps it, and the others
    change; it ends when a count finds nothing, so the result is checked and not assumed. A value's keeper is found by aggregation, before
    the shuffle in part, so no task gets all rows of a frequent value. `draws` are further draws as functions of `_rid`,
    tried in turns; `n` is the number of rows, which keeps row ids of later rounds apart.
    """
    kind = dict(df.dtypes)[column]
    n = df.count() if n is None else n
    # Only values that occur twice are ever looked at again: rows with them, and what they became.
    now = df.withColumns({"_value": F.col(f"`{column}`"), "_since": F.lit(0)})
    changed, turn = None, 0
    while True:
        state = now if changed is None else now.join(changed.select("_rid", F.col("_new"), F.col("_at")), "_rid", "left").withColumns({"_value": F.coalesce("_new", "_value"), "_since": F.coalesce("_at", "_since")}).drop("_new", "_at")
        keeper = state.where("_value IS NOT NULL").groupBy(F.col("_value").alias("_v")).agg(F.min(F.struct("_since", "_rid")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        # A frequent value's rows all meet its one keeper: Spark splits that join.
        losers = state.join(keeper, F.col("_value") == F.col("_v")).where(F.col("_rid") != F.col("_first._rid")).select("_rid", F.col(f"`{column}`").alias("_old"))
        losers = stored(losers, "repeats")
        if losers.isEmpty():
            return state.select(*[(F.col("_value") if c == column else F.col(f"`{c}`")).alias(c) for c in df.columns])
        turn += 1
        if turn <= len(draws):
            new = draws[turn - 1]
        else:
            new = apart(F.col("_old"), kind, F.col("_rid") + F.lit((turn - len(draws) - 1) * (n + 1)).cast("long"))
        moved = losers.select("_rid", new.cast(kind).alias("_new"), F.lit(turn).alias("_at"))
        changed = stored(moved if changed is None else changed.join(moved, "_rid", "left_anti").unionByName(moved), "changed")


def edited(c: Column, kind: str, seed: int, column: str, digits: int = 2) -> Column:
    """A value with a small edit, drawn by row id: a text has two neighbours swapped, a character dropped or its case flipped, a whole number
    moves by 1, another one by up to 1 %. Texts of one character, and other types, stay."""
    u = lambda what: rng.uniform(seed, f"edit {what}:{column}", F.col("_rid"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return (c + F.when(u("side") < 0.5, -1).otherwise(1)).cast(kind)
    if kind in ("float", "double"):
        return F.round(c * (0.99 + 0.02 * u("side")), digits).cast(kind)
    if kind not in ("string", "varchar"):
        return c
    size = F.length(c)
    at = (F.floor(u("place") * (size - 1)) + 1).cast("int")
    cut = lambda a, b: F.substring(c, a, b)
    start, rest = cut(F.lit(1), at - 1), cut(at + 2, size)
    swapped = F.concat(start, cut(at + 1, F.lit(1)), cut(at, F.lit(1)), rest)
    dropped = F.concat(start, cut(at + 1, size))
    flipped = F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))
    return F.when(size < 2, c).when(u("mode") < 1 / 3, swapped).when(u("mode") < 2 / 3, dropped).otherwise(flipped)


def near_duplicates(df: DataFrame, columns: list[str], seed: int, rate: float = 0.02, flag: int = 6) -> DataFrame:
    """At `rate`, a row takes an earlier row's values in `columns`, and one of them, drawn by row, gets a small edit.

    The source is the earlier row as it was generated, so all rows are found by one join on drawn row ids. `_copied` says which rows;
    where a column has a flag `_f_<column>`, the edited cell's becomes `flag` and the others come along.
    """
    kinds, u = dict(df.dtypes), lambda what: rng.uniform(seed, what, F.col("_rid"))
    flags = {c: f"_f_{c}" for c in columns if f"_f_{c}" in df.columns}
    able = [c for c in columns if kinds[c] in ("string", "tinyint", "smallint", "int", "bigint", "float", "double")]
    source = F.when((u("copy") < rate) & (F.col("_rid") > 0), F.floor(u("source") * F.col("_rid")).cast("long"))
    other = df.select(F.col("_rid").alias("_src"), *[F.col(f"`{c}`").alias(f"_o_{c}") for c in [*columns, *flags.values()]])
    joined = df.withColumn("_src", source).join(other, "_src", "left")
    here = F.col("_src").isNotNull()
    which = F.floor(u("edited") * len(able)) if able else F.lit(-1)
    out = {c: F.col(f"`{c}`") for c in df.columns}
    for c in columns:
        old = F.col(f"`_o_{c}`")
        mine = which == able.index(c) if c in able else F.lit(False)
        out[c] = F.when(here & mine, edited(old, kinds[c], seed, c)).when(here, old).otherwise(F.col(f"`{c}`"))
        if c in flags:
            out[flags[c]] = F.when(here & mine, F.lit(flag).cast("byte")).when(here, F.col(f"`_o_{flags[c]}`")).otherwise(F.col(f"`{flags[c]}`"))
    return joined.select(*[x.alias(c) for c, x in out.items()], here.alias("_copied"))
