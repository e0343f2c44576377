"""Dates, times of day (whole milliseconds) and timestamps (whole seconds) of the legacy dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def make_date(day: Column, month: Column, year: Column) -> Column:
    """Null for what is no date, and for years outside 0 to 9999."""
    good = day.between(1, 31) & month.between(1, 12) & year.between(0, 9999)
    return F.when(good, F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))


def make_time(hour: Column, minute: Column, second: Column, ms: Column) -> Column:
    good = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59) & ms.between(0, 999)
    return F.when(good, ((hour * 60 + minute) * 60 + second) * 1000 + ms).cast("int")


def hours(t: Column) -> Column:
    return F.floor(t / 3_600_000).cast("int")


def minutes(t: Column) -> Column:
    return F.floor(t / 60_000).cast("int") % 60


def seconds(t: Column) -> Column:
    return F.floor(t / 1000).cast("int") % 60


def sec1000(t: Column) -> Column:
    return t % 1000


def day_of_week(d: Column) -> Column:
    """0 for Sunday to 6; 7 for null."""
    return F.coalesce(F.dayofweek(d) - 1, F.lit(7))


def date_plus(d: Column, days: Column) -> Column:
    return F.date_add(d, days)


def date_diff(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def ts_plus(ts: Column, n: Column) -> Column:
    """Seconds later."""
    return F.timestamp_add("SECOND", n, ts)


def ts_diff(a: Column, b: Column) -> Column:
    """Seconds from b to a."""
    return F.timestamp_diff("SECOND", b, a)


def time_plus(t: Column, ms: Column) -> Column:
    return t + ms


def time_minus(t: Column, ms: Column) -> Column:
    """Wraps at midnight."""
    return F.pmod(t - ms, F.lit(DAY_MS))


def time_diff(a: Column, b: Column) -> Column:
    return a - b


def datetime_to_timestamp(d: Column, t: Column) -> Column:
    return F.timestamp_add("SECOND", F.floor(t / 1000).cast("int"), d.cast("timestamp_ntz"))


def timestamp_to_date(ts: Column) -> Column:
    return F.to_date(ts)


def timestamp_to_time(ts: Column) -> Column:
    return ((F.hour(ts) * 60 + F.minute(ts)) * 60 + F.second(ts)) * 1000


def today() -> Column:
    return F.current_date()


def now() -> Column:
    """The time of day in milliseconds."""
    t = F.current_timestamp()
    return (((F.hour(t) * 60 + F.minute(t)) * 60 + F.second(t)) * 1000).cast("int")
