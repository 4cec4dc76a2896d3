"""Columns that depend on every earlier row of a key, where no window function can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_in_order(df: DataFrame, key: str, order: list[str], inputs: list[str], begin: Callable[[], object], step: Callable, results: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Add `results` by `step(state, *inputs) -> (state, values)` over each key's rows in order.

    Rows are dealt by key and sorted by Spark, which spills; a task reads them batch by batch and holds one state, so a key of any
    size needs no more memory than its state. A null key is a key of its own. Ties in `order` are taken in any order.
    """

    def run(batches):
        last, state = (), None  # no key equals ()
        for b in batches:
            found: list[list] = [[] for _ in results]
            for k, *x in zip(*(b.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if k != last:
                    last, state = k, begin()
                state, values = step(state, *x)
                for column, v in zip(found, values, strict=True):
                    column.append(v)
            new = [pa.array(c, t) for c, (_, t) in zip(found, results.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *results])

    kinds = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{c}` {t}" for c, (t, _) in results.items()])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)
