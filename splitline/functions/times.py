"""Dates, seasons, times and marks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def season_year(day: Column, month: int = 8, date: int = 1) -> Column:
    """The year a season opened: from month-date on this year, else the year before."""
    opened = (F.month(day) > month) | ((F.month(day) == month) & (F.dayofmonth(day) >= date))
    return F.year(day) - F.when(opened, 0).otherwise(1)


def week_key(day: Column) -> Column:
    """The Friday on or before ``day``."""
    return F.date_sub(day, (F.weekday(day) + 3) % 7)


def parse_time(text: Column) -> Column:
    """Seconds of [h:]mm:ss[.f], mm:ss or ss; null where it isn't one."""
    t = F.trim(text)
    part = F.split(t, ":")
    value = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    n = F.size(part)
    seconds = F.when(n == 1, value(1)).when(n == 2, value(1) * 60 + value(2)).when(n == 3, value(1) * 3600 + value(2) * 60 + value(3))
    return F.when(t.rlike(r"^(\d+:)?(\d{1,2}:)?\d{1,2}(\.\d+)?$"), seconds)


def format_time(seconds: Column) -> Column:
    """h:mm:ss.cc or m:ss.cc, in hundredths (half up)."""
    c = F.floor(seconds * 100 + 0.5).cast("long")
    h, m, s, f = F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = F.concat(two(s), F.lit("."), two(f))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), tail)).otherwise(F.concat(m.cast("string"), F.lit(":"), tail))


def decay_weight(day: Column, today: Column, rate: float = 0.996) -> Column:
    """rate ** days since ``day``; 0 for days to come."""
    age = F.datediff(today, day)
    return F.when(age >= 0, F.pow(F.lit(rate), age)).otherwise(0.0)
