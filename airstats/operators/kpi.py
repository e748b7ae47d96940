"""Load totals, headline figures and the monthly trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airstats.functions import share_of
from airstats.operators.airports import airport_counts, first_by

# Fixed value: minutes after which an arrival is late.
LATE_AFTER = 15


def load_totals(df: DataFrame) -> DataFrame:
    """Rows, years and months of a loaded table."""
    # Rows are counted per month first; the distinct counts run over those few groups.
    months = df.groupBy("year", "month").agg(F.count("*").alias("n"))
    return months.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.countDistinct("year").alias("years"),
        F.count_if(F.col("year").isNotNull() & F.col("month").isNotNull()).alias("months"),
    )


def kpis(df: DataFrame, late_after: float = LATE_AFTER) -> DataFrame:
    """One row: flights, share late, worst carrier, busiest airport, airports, mean temperature.

    Totals and the worst carrier come from one pass grouped by carrier, airports from a second.
    """
    late = F.col("arr_delay") > late_after
    by_carrier = df.groupBy("op_carrier").agg(
        F.count("*").alias("n"),
        F.count("arr_delay").alias("known"),
        F.count_if(late).alias("late"),
        F.sum(F.col("o_temp").cast("double")).alias("o_sum"), F.count("o_temp").alias("o_n"),
        F.sum(F.col("d_temp").cast("double")).alias("d_sum"), F.count("d_temp").alias("d_n"),
    )
    rate = share_of(F.col("late"), F.col("known"))
    named = F.when(F.col("op_carrier").isNotNull() & (F.col("known") > 0), F.struct(-rate, "op_carrier"))
    totals = by_carrier.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_flights"),
        share_of(F.sum("late"), F.sum("known")).alias("late_share"),
        F.min_by("op_carrier", named).alias("worst_carrier"),
        share_of(F.coalesce(F.sum("o_sum"), F.lit(0)) + F.coalesce(F.sum("d_sum"), F.lit(0)),
                 F.sum("o_n") + F.sum("d_n")).alias("mean_temp"),
    )
    airports = airport_counts(df).agg(F.struct(
        first_by("code", "total_flights").alias("busiest"), F.count("*").alias("n"))).scalar()
    return totals.select(
        "total_flights", "late_share", "worst_carrier",
        airports["busiest"].alias("busiest_airport"), airports["n"].alias("airports"), "mean_temp",
    )


def monthly_trend(df: DataFrame, late_after: float = LATE_AFTER) -> DataFrame:
    """Flights, mean arrival delay and share late per month."""
    return (
        df.groupBy("month")
        .agg(
            F.count("*").alias("flights"),
            F.avg("arr_delay").alias("mean_delay"),
            F.avg((F.col("arr_delay") > late_after).cast("int")).alias("late_share"),
        )
        .orderBy("month")
    )
