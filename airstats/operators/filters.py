"""Row filters, projections and domain checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airstats.functions import month_of, year_of
from airstats.schema import ESSENTIAL

# Fixed values: (lon from, lon to, lat from, lat to) of the two maps, and the columns of a model.
MAP_BOX = (-130.0, -65.0, 20.0, 55.0)
SMALL_MAP_BOX = (-125.0, -66.0, 24.0, 50.0)
MODEL_COLUMNS = (
    "ARR_DELAY", "DEP_DELAY", "CRS_DEP_TIME", "CRS_ELAPSED_TIME", "OP_CARRIER", "ORIGIN", "DEST",
    "MONTH", "DAY_OF_WEEK", "O_PRCP", "O_WSPD", "D_PRCP", "D_WSPD",
)
DELAY_COLUMNS = ("ARR_DELAY", "DEP_DELAY")
WEATHER_COLUMNS = ("O_PRCP", "O_WSPD", "D_PRCP", "D_WSPD")


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` the table has, whatever their letter case, in the table's spelling."""
    spelling = {c.lower(): c for c in df.columns}
    return [spelling[c.lower()] for c in cols if c.lower() in spelling]


def require(df: DataFrame, cols: Sequence[str] = ESSENTIAL) -> DataFrame:
    """Rows in which none of ``cols`` is null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def with_year_month(df: DataFrame, date_col: str = "fl_date") -> DataFrame:
    return df.withColumns({"year": year_of(date_col), "month": month_of(date_col)})


def for_year(df: DataFrame, year: int) -> DataFrame:
    """Rows of one year whose month could be read."""
    return df.where((F.col("year") == year) & F.col("month").isNotNull())


def scan_months(df: DataFrame, months: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Some months, some columns. On a partitioned table Catalyst prunes both at the scan."""
    return df.where(F.col("month").isin(*months)).select(*columns)


def in_box(df: DataFrame, box: tuple[float, float, float, float] = MAP_BOX,
           lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points inside a map's viewport, borders included."""
    west, east, south, north = box
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def clean_for_model(df: DataFrame, on_null_delay: str = "drop", keep: Sequence[str] = (),
                    tolerant: bool = False) -> DataFrame:
    """Project to the model's columns, weather nulls to 0, rows without a delay out.

    ``on_null_delay="zero"`` keeps those rows as delay 0, which is how the stored models are
    evaluated. ``tolerant`` accepts a table that lacks some of the columns.
    """
    if on_null_delay not in ("drop", "zero"):
        raise ValueError(f"unknown on_null_delay: {on_null_delay}")
    wanted = present(df, MODEL_COLUMNS) if tolerant else list(MODEL_COLUMNS)
    zero_filled = {c.lower() for c in WEATHER_COLUMNS}
    delays = present(df, DELAY_COLUMNS)
    if on_null_delay == "zero":
        zero_filled |= {c.lower() for c in delays}
    elif delays:
        df = require(df, delays)

    def cleaned(name: str) -> Column:
        c = F.col(name)
        return (F.coalesce(c, F.lit(0)) if name.lower() in zero_filled else c).alias(name.lower())

    return df.select(*keep, *[cleaned(c) for c in wanted])


def missing_codes(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    """Codes in low..high that never occur in ``col``."""
    # At most high - low + 1 codes survive the filter, so the broadcast is bounded.
    seen = df.where(F.col(col).between(low, high)).select(F.col(col).cast("int").alias("code")).distinct()
    domain = df.sparkSession.range(low, high + 1, numPartitions=1).select(F.col("id").cast("int").alias("code"))
    return domain.join(F.broadcast(seen), "code", "left_anti")


def temporal_coverage(df: DataFrame, month: str = "month", day: str = "day_of_week") -> DataFrame:
    """Months 1-12 and weekdays 1-7 that do not occur."""
    months = missing_codes(df, month, 1, 12).select(F.lit("month").alias("part"), "code")
    days = missing_codes(df, day, 1, 7).select(F.lit("day").alias("part"), "code")
    return months.unionByName(days)
