"""Date arithmetic with the units the cohort rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440.0


def plus_days(ts: Column, days: int) -> Column:
    """``ts`` moved by whole days, keeping the time of day."""
    return ts + F.make_dt_interval(F.lit(days))


def midnight_after(ts: Column, days: int) -> Column:
    """Midnight at the start of the day ``days`` after the day of ``ts``."""
    return F.date_add(ts.cast("date"), days).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later.cast("date"), earlier.cast("date"))


def elapsed_days(start: Column, stop: Column) -> Column:
    """Elapsed time in days, in whole minutes (seconds are dropped)."""
    return F.timestamp_diff("MINUTE", start, stop) / F.lit(MINUTES_PER_DAY)


def minutes_to_days(minutes: Column, digits: int | None = 2) -> Column:
    days = minutes / F.lit(MINUTES_PER_DAY)
    return days if digits is None else F.round(days, digits)
