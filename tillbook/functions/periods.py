"""Date and period helpers built on Spark SQL functions.

A period is ``(month, year)``: month+year selects one month, year alone a
year, neither selects everything, and a month without a year is ignored.
Filters are half-open date ranges so Parquet min/max statistics and partition
pruning apply (an EXTRACT on the column would not prune).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_bounds(month: int | None = None, year: int | None = None):
    """(start, end) dates of the period, or None for "everything"."""
    if year and month:
        start = dt.date(int(year), int(month), 1)
        end = dt.date(int(year) + (int(month) == 12), int(month) % 12 + 1, 1)
        return start, end
    if year:
        return dt.date(int(year), 1, 1), dt.date(int(year) + 1, 1, 1)
    return None


def period_predicate(col: str | Column, month: int | None = None, year: int | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    bounds = period_bounds(month, year)
    if bounds is None:
        return F.lit(True)
    start, end = bounds
    return (c >= F.lit(start)) & (c < F.lit(end))


# Month partition column written next to a date column by the model store.
MONTH_PARTITION = {"transaction_date": "sale_month", "sale_date": "cube_month", "log_date": "log_month", "entry_date": "entry_month"}


def _month_prune(df: DataFrame, col: str, start: dt.date, end_exclusive: dt.date) -> DataFrame:
    """Add the equivalent predicate on a 'yyyy-MM' partition column, if the
    frame has one, so a stored table skips whole month folders."""
    part = MONTH_PARTITION.get(col)
    if part is None or part not in df.columns:
        return df
    last = end_exclusive - dt.timedelta(days=1)
    return df.filter((F.col(part) >= F.lit(start.strftime("%Y-%m"))) &
                     (F.col(part) <= F.lit(last.strftime("%Y-%m"))))


def in_period(df: DataFrame, col: str, month: int | None = None, year: int | None = None) -> DataFrame:
    """B2."""
    bounds = period_bounds(month, year)
    if bounds is None:
        return df
    return _month_prune(df.filter(period_predicate(col, month, year)), col, *bounds)


def on_date(df: DataFrame, col: str, day) -> DataFrame:
    """B1: rows of one calendar day."""
    d = _as_date(day)
    return _month_prune(df.filter(F.col(col) == F.lit(d)), col, d, d + dt.timedelta(days=1))


def _as_date(day) -> dt.date:
    if isinstance(day, dt.date):
        return day
    return dt.date.fromisoformat(str(day))


def local_date(ts: str | Column, zone: str = "Asia/Jakarta") -> Column:
    """Wall-clock date in the business time zone of a UTC instant."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.from_utc_timestamp(c, zone))


def local_time(ts: str | Column, zone: str = "Asia/Jakarta") -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.from_utc_timestamp(c, zone), "HH:mm:ss")


def day_spine(end_day, days: int = 7) -> Column:
    """Array of the ``days`` dates ending at ``end_day`` (inclusive)."""
    end = F.lit(_as_date(end_day))
    return F.sequence(F.date_sub(end, days - 1), end)


def weekday_label(d: str | Column) -> Column:
    """Short weekday label such as ``Mon``."""
    c = F.col(d) if isinstance(d, str) else d
    return F.date_format(c, "EEE")


def period_label(month: int | None = None, year: int | None = None) -> Column:
    """Statement heading of a period: ``March 1997``, ``Year 1998`` or
    ``All periods`` (a month without a year is ignored, as in B2)."""
    if year and month:
        return F.date_format(F.make_date(F.lit(int(year)), F.lit(int(month)), F.lit(1)), "MMMM yyyy")
    if year:
        return F.lit(f"Year {int(year)}")
    return F.lit("All periods")
