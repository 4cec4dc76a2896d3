"""Checks on streams: rules per micro-batch, and a sliding-window rate limit with state for each visitor."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold_in_order
from ..operators.rules import Rule, check

LIMIT = 20
WINDOW_S = 60


def density(key: str, ts: str, seconds: int = WINDOW_S) -> Column:
    """Requests of a visitor in the window that ends at each one."""
    return F.count("*").over(Window.partitionBy(key).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0))


def _admit(times: list[float], recent: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """A rejected request does not count, so a decision depends on the ones before; at most `limit` times are kept."""
    out = []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def admitted(df: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """The rows (key, order, ts) with `admitted`, folded in order within each visitor; a row without a time is not admitted."""

    def step(recent: deque, t: float | None):
        while t is not None and recent and recent[0] <= t - seconds:
            recent.popleft()
        good = t is not None and len(recent) < limit
        if good:
            recent.append(t)
        return recent, (good,)

    timed = df.select(key, order, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))
    return fold_in_order(timed, key, [ts, order], ["_t"], deque, step, {"admitted": ("boolean", pa.bool_())}).drop("_t")


def admitted_stream(df: DataFrame, key: str, ts: str, limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """The same on a stream: the state of a visitor is its admitted times of the last window."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts)
        good, recent = _admit((rows[ts].astype("datetime64[us]").astype("int64") / 1e6).tolist(), recent, limit, seconds)
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts], "admitted": good})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def _in_order(pending: list[int], recent: list[int], watermark: int, limit: int, window: int) -> tuple[list[tuple[int, bool]], list[int], list[int]]:
    """Decisions on the requests up to the watermark, and what stays: the others, and the admitted ones that can still count."""
    out = []
    for t in sorted(x for x in pending if x <= watermark):
        recent = [x for x in recent if x > t - window]
        good = len(recent) < limit
        out.append((t, good))
        if good:
            recent.append(t)
    return out, [x for x in pending if x > watermark], [x for x in recent if x > watermark - window]


def admitted_by_event_time(df: DataFrame, key: str, ts: str, delay: str = "30 seconds", limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """The rate limit on a stream whose requests arrive out of order: (key, ts, admitted), each decided once the watermark has passed it.

    Until then it waits in its visitor's state, so decisions are those of the ordered table however rows fall into batches. A visitor is
    called again by a timer when the watermark reaches its first waiting request, and its state goes when no admitted request can count
    any more. Requests that come later than `delay` are dropped by the watermark: they are neither decided nor counted. A request without
    a time is dropped too.
    """
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, recent = (list(x) for x in state.get) if state.exists else ([], [])
        for b in batches:
            pending += b["_t"].tolist()
        watermark = state.getCurrentWatermarkMs() * 1000
        done, pending, recent = _in_order(pending, recent, watermark, limit, seconds * 1_000_000)
        if pending or recent:
            state.update((pending, recent))
            wake = min(pending) if pending else max(recent) + seconds * 1_000_000
            state.setTimeoutTimestamp(max(wake // 1000 + 1, watermark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(done), "_t": [t for t, _ in done], "admitted": [g for _, g in done]})

    timed = df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    kind = dict(df.dtypes)[key]
    out = timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, _t long, admitted boolean", "pending array<long>, recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("_t").alias(ts), "admitted")


def check_batches(stream: DataFrame, rules: list[Rule], report: Callable[[int, DataFrame], None]):
    """Start a query that checks every micro-batch against the rules and hands the one-row result to `report`."""
    return stream.writeStream.foreachBatch(lambda batch, number: report(number, check(batch, rules)))
