"""Lenient reading of numbers, years, months and hours from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
YEAR_PATTERN = r"^(\d{4})"
MONTH_PATTERN = r"-(\d{1,2})-"
DEFAULT_HOUR = 12

# Spark reads '1d', '1f', 'Infinity' and 'NaN' as doubles; a plain decimal number is asked for.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_of(date_text: Column | str) -> Column:
    """Leading four digits of a date text as int, else null."""
    return F.regexp_extract(_col(date_text), YEAR_PATTERN, 1).try_cast("int")


def month_of(date_text: Column | str) -> Column:
    """The first one or two digits between dashes as int, else null."""
    return F.regexp_extract(_col(date_text), MONTH_PATTERN, 1).try_cast("int")


def to_number(c: Column | str, default: float | None = 0.0) -> Column:
    """Text or number as double; what cannot be read becomes ``default``."""
    text = _col(c).cast("string")
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def hhmm_hour(c: Column | str) -> Column:
    """Hour of a clock time written HHMM; unreadable times count as 0."""
    whole = F.coalesce(to_number(c).try_cast("bigint"), F.lit(0))
    return F.floor(whole / 100).cast("int")


def _clock_hour(c: Column | str) -> Column:
    """Hour of a date-time text or a bare clock time, null if it is neither, as bare digits are.

    Read as wall-clock time, so the session time zone and its daylight gaps play no part.
    """
    text = _col(c).cast("string")
    return F.when(~text.rlike(r"^\s*\d+\s*$"), F.coalesce(
        F.hour(text.try_cast("timestamp_ntz")),
        F.hour(F.concat(F.lit("1970-01-01 "), text).try_cast("timestamp_ntz")),
    ))


def datetime_hour(c: Column | str, default: int = DEFAULT_HOUR) -> Column:
    """Hour of a date-time text; ``default`` where it cannot be read."""
    return F.coalesce(_clock_hour(c), F.lit(default))


def dep_hour(c: Column | str, time_format: str = "hhmm", default: int = 0) -> Column:
    """Departure hour of ``hhmm`` or ``datetime`` text; ``auto`` takes each row as it is written.

    ``default`` stands for a text that is neither; ``hhmm`` alone reads such a text as 0.
    """
    if time_format == "hhmm":
        return hhmm_hour(c)
    if time_format == "datetime":
        return datetime_hour(c, default)
    if time_format == "auto":
        return F.when(to_number(c, None).isNotNull(), hhmm_hour(c)).otherwise(datetime_hour(c, default))
    raise ValueError(f"unknown time format: {time_format}")


def first_token(c: Column | str) -> Column:
    """Text before the first blank: ``AA (Name)`` gives ``AA``."""
    return F.split(_col(c), " ").getItem(0)


def code_text(c: Column | str, null_text: str = "nan") -> Column:
    """Code as text; a missing code is the text ``nan`` and counts as a code of its own."""
    return F.coalesce(_col(c).cast("string"), F.lit(null_text))
