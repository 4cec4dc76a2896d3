"""A keyed permutation of 0 .. n-1 as a Column: draws without replacement, without a sort and without looking at other rows.

n numbers are the cells of a grid of a x b, with a and b near the square root of n and as few cells to spare as possible. A cell's
row and column are moved in turns, each by a draw from the other (an alternating Feistel network on Z_a x Z_b), which is a permutation of
the grid. A number that lands on a spare cell is moved on until it doesn't; that takes at most as many moves as there are spare cells.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rng

TURNS = 4
#: Row lengths that are tried for a grid with few spare cells.
TRIED = 20_000


def grid(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and few spare cells."""
    if n < 1:
        raise ValueError("a permutation needs at least one number")
    root = isqrt(n - 1) + 1
    lengths = range(root, max(0, root // 2 - 1, root - TRIED), -1)
    a = min(lengths, key=lambda a: (a * -(-n // a) - n, -a))
    return a, -(-n // a)


def _draw(v: Column, m: int, seed: int, stream: str, turn: int, key: Column | None) -> Column:
    named = v if key is None else F.concat_ws(":", key.cast("string"), v.cast("string"))
    return rng.integer(rng.uniform(seed, stream, named, turn), 0, m - 1)


def permuted(x: Column, n: int, seed: int, stream: str, key: Column | None = None) -> Column:
    """The place of x (0 .. n-1) in a permutation given by seed, stream and, row by row, `key`."""
    a, b = grid(n)

    def once(v: Column) -> Column:
        row, column = v % a, F.floor(v / a).cast("long")
        for turn in range(TURNS):
            if turn % 2:
                column = (column + _draw(row, b, seed, stream, turn, key)) % b
            else:
                row = (row + _draw(column, a, seed, stream, turn, key)) % a
        return (column * a + row).cast("long")

    moved = once(x.cast("long"))
    if a * b == n:
        return moved
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), moved, lambda at, _: F.when(at < n, at).otherwise(once(at)))


def permuted_sql(rows: str, x: str, n: int, seed: int, stream: str, key: str | None = None, out: str = "y") -> str:
    """DuckDB SQL: the rows of a subquery with permuted() of the SQL expression x as `out`."""
    a, b = grid(n)

    def once(source: str, at: str) -> str:
        step = f"SELECT *, ({at})::BIGINT % {a} AS _r, ({at})::BIGINT // {a} AS _c FROM ({source})"
        for turn in range(TURNS):
            own, other, m = ("_c", "_r", b) if turn % 2 else ("_r", "_c", a)
            named = other if key is None else f"({key} || ':' || {other})"
            step = f"SELECT * REPLACE (({own} + floor({rng.uniform_sql(seed, stream, named, turn)} * {m})::BIGINT) % {m} AS {own}) FROM ({step})"
        return f"SELECT * EXCLUDE (_r, _c), _c * {a} + _r AS _y FROM ({step})"

    found = once(rows, x)
    for _ in range(a * b - n):
        found = f"SELECT * EXCLUDE (_x, _y), CASE WHEN _x < {n} THEN _x ELSE _y END AS _y FROM ({once(f'SELECT * RENAME (_y AS _x) FROM ({found})', '_x')})"
    return f"SELECT * RENAME (_y AS {out}) FROM ({found})"
