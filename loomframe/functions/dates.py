"""Reading dates in several formats, and the format that a column uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"(?:[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?)?"
_ISO = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME + r"(Z|[+-][0-9]{2}:?[0-9]{2})?$"
_LOCAL = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})(?:[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)? ?([AaPp][Mm])?$"
_NAMED = r"^(?:([0-9]{1,2}) ([A-Za-z]{3})[a-z]*,? ([0-9]{4})|([A-Za-z]{3})[a-z]* ([0-9]{1,2}),? ([0-9]{4}))$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _stamp(y, m, d, h, mi, s) -> Column:
    return F.try_make_timestamp(y, m, d, F.coalesce(h, F.lit(0)), F.coalesce(mi, F.lit(0)), F.coalesce(s, F.lit(0)).cast("decimal(8,6)"))


def _iso(c: Column) -> Column:
    stamp = _stamp(*[_int(c, _ISO, g) for g in range(1, 7)])
    zone = F.regexp_extract(c, _ISO, 7)
    minutes = F.regexp_extract(zone, "([0-9]{2}):?([0-9]{2})", 1).try_cast("int") * 60 + F.regexp_extract(zone, "([0-9]{2}):?([0-9]{2})", 2).try_cast("int")
    shift = F.coalesce(F.when(zone.startswith("-"), -minutes).otherwise(minutes), F.lit(0))
    return F.timestamp_micros(F.unix_micros(stamp) - shift.cast("long") * 60_000_000)


def _local(c: Column) -> tuple[Column, Column]:
    """Read with the day first, and with the month first."""
    a, b, y, h, mi, s = (_int(c, _LOCAL, g) for g in range(1, 7))
    half = F.lower(F.regexp_extract(c, _LOCAL, 7))
    hour = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    return _stamp(y, b, a, hour, mi, s), _stamp(y, a, b, hour, mi, s)


def _named(c: Column) -> Column:
    month = lambda g: F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(c, _NAMED, g))).cast("int")
    zero = F.lit(0)
    return F.coalesce(_stamp(_int(c, _NAMED, 3), month(2), _int(c, _NAMED, 1), zero, zero, zero), _stamp(_int(c, _NAMED, 6), month(4), _int(c, _NAMED, 5), zero, zero, zero))


def read_date(text: Column, day_first: bool | Column = True) -> Column:
    """A timestamp from ISO (with optional offset), day-month-year or month-day-year with optional time and AM/PM, or month names; null for impossible dates."""
    c = F.trim(text)
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    by_day, by_month = _local(c)
    return F.when(c.rlike(_ISO), _iso(c)).when(c.rlike(_LOCAL), F.when(day_first, by_day).otherwise(by_month)).when(c.rlike(_NAMED), _named(c))


def formed(text: Column) -> Column:
    """Whether a text has the form of a date, possible or not."""
    c = F.trim(text)
    return c.rlike(_ISO) | c.rlike(_LOCAL) | c.rlike(_NAMED)


def reads_as_date(text: Column) -> Column:
    """Whether read_date() reads a text with the day or with the month first; null for null."""
    c = F.trim(text)
    by_day, by_month = _local(c)
    return F.when(c.rlike(_ISO), _iso(c).isNotNull()).when(c.rlike(_LOCAL), by_day.isNotNull() | by_month.isNotNull()).when(c.rlike(_NAMED), _named(c).isNotNull()).when(c.isNotNull(), False)


def date_evidence(df: DataFrame, column: str) -> DataFrame:
    """One row: values, how many read as dates with the day or the month first, and day_first (a first number above 12 proves it)."""
    c = F.trim(F.col(column))
    first, second = _int(c, _LOCAL, 1), _int(c, _LOCAL, 2)
    return df.agg(
        F.count(c).alias("n"), F.count(read_date(c, True)).alias("n_day_first"), F.count(read_date(c, False)).alias("n_month_first"),
        (F.coalesce(F.sum((first > 12).cast("int")), F.lit(0)) >= F.coalesce(F.sum((second > 12).cast("int")), F.lit(0))).alias("day_first"),
    )
