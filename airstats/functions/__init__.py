"""Column expressions. All of them stay inside the JVM."""

from airstats.functions.calendar import (
    PEAK_HOURS, calendar_date, calendar_month, is_peak, is_weekend, iso_weekday, season, time_of_day,
)
from airstats.functions.delay import (
    DELAY_LEVELS, STRATA, Stratum, delay_group, delay_level, quota_of,
)
from airstats.functions.keyed import hash52, key_text, uniform
from airstats.functions.parse import (
    code_text, datetime_hour, dep_hour, first_token, hhmm_hour, month_of, to_number, year_of,
)
from airstats.functions.report import argmax, class_text, marker_size, share_of, winning_percent

__all__ = [
    "DELAY_LEVELS", "PEAK_HOURS", "STRATA", "Stratum", "argmax", "calendar_date", "calendar_month",
    "class_text", "code_text", "datetime_hour", "delay_group", "delay_level", "dep_hour",
    "first_token", "hash52", "hhmm_hour", "is_peak", "is_weekend", "iso_weekday", "key_text",
    "marker_size", "month_of", "quota_of", "season", "share_of", "time_of_day", "to_number",
    "uniform", "winning_percent", "year_of",
]
