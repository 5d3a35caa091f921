"""Trading calendars: weekdays, and New York exchange days by the exchange's published holiday rules."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Full-day closures outside the yearly rules.
CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14",  # September 11
    "2004-06-11", "2007-01-02", "2018-12-05", "2025-01-09",  # days of mourning
    "2012-10-29", "2012-10-30",  # hurricane
)


def easter(year: int) -> date:
    """Gregorian Easter Sunday (anonymous algorithm)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    n = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * n) // 451
    month, day = divmod(h + n - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month, the last for n = -1."""
    if n < 0:
        last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
        return last - timedelta(days=(last.weekday() - weekday) % 7)
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _observed(d: date) -> date | None:
    """Saturday holidays move to Friday, Sunday ones to Monday; a Saturday New Year is not moved."""
    if d.weekday() == 5:
        return None if (d.month, d.day) == (1, 1) else d - timedelta(days=1)
    return d + timedelta(days=1) if d.weekday() == 6 else d


def holidays(year: int) -> set[date]:
    out = {_observed(date(year, 1, 1)), _nth(year, 2, 0, 3), easter(year) - timedelta(days=2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if year >= 1998:
        out.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return {d for d in out if d} | {date.fromisoformat(c) for c in CLOSURES if c.startswith(str(year))}


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.filter(F.weekday("date") < 5)


def exchange_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays without the holidays, some ten a year."""
    years = range(int(start[:4]), int(end[:4]) + 1)
    off = spark.createDataFrame([(d,) for y in years for d in sorted(holidays(y))], "date date")
    return weekdays(spark, start, end).join(F.broadcast(off), "date", "left_anti")
