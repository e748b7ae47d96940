"""Weekday, season and time-of-day expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airstats.functions.parse import _col

# Fixed values.
PEAK_HOURS = (6, 7, 8, 9, 16, 17, 18, 19)
SEASONS = {"Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
OTHER_SEASON = "Winter"
NO_SEASON = "Unknown"
TIMES_OF_DAY = ((6, 0), (12, 1), (18, 2))
LAST_TIME_OF_DAY = 3
FIRST_WEEKEND_DAY = 6


def calendar_date(c: Column | str) -> Column:
    """Date of a date or date-time text, null if it cannot be read."""
    return _col(c).try_cast("date")


def iso_weekday(c: Column | str) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(calendar_date(c)) + 1


def calendar_month(c: Column | str) -> Column:
    return F.month(calendar_date(c))


def is_weekend(day: Column | str) -> Column:
    """1 on days 6 and 7; an unknown day is no weekend."""
    return F.when(_col(day) >= FIRST_WEEKEND_DAY, 1).otherwise(0)


def season(month: Column | str) -> Column:
    """Season of a month number. Anything readable outside March to November is winter."""
    whole = _col(month).try_cast("bigint")
    name = F.when(whole.isNull(), NO_SEASON)
    for label, months in SEASONS.items():
        name = name.when(whole.isin(*months), label)
    return name.otherwise(OTHER_SEASON)


def time_of_day(hour: Column | str) -> Column:
    """0 night, 1 morning, 2 afternoon, 3 evening; null stays null."""
    h = _col(hour)
    bucket = F.when(h.isNull(), F.lit(None).cast("int"))
    for before, code in TIMES_OF_DAY:
        bucket = bucket.when(h < before, code)
    return bucket.otherwise(LAST_TIME_OF_DAY)


def is_peak(hour: Column | str) -> Column:
    """True in the morning and late-afternoon peak hours; an unknown hour is not one."""
    return F.coalesce(_col(hour).isin(*PEAK_HOURS), F.lit(False))
