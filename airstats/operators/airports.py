"""Airport statistics and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Right-closed bins of flights per airport and their labels.
COUNT_EDGES = (0, 10, 50, 100, 200, 500, 1000)
COUNT_LABELS = (
    "Rất ít (0-10)", "Ít (11-50)", "Trung bình (51-100)",
    "Nhiều (101-200)", "Rất nhiều (201-500)", "Cực nhiều (500+)",
)


def both_ends(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """One row per end of a flight. ``code=("origin", "dest")`` names the column at either end."""
    ends = [F.struct(*[F.col(cols[i]).alias(out) for out, cols in pairs.items()]) for i in (0, 1)]
    return df.select(F.inline(F.array(*ends)))


def airport_counts(df: DataFrame) -> DataFrame:
    """Coordinates and number of departures plus arrivals of each airport, in no order.

    Both ends come from one scan. The least coordinate stands for an airport, so the result does
    not depend on row order.
    """
    ends = both_ends(
        df, code=("origin", "dest"), lat=("o_latitude", "d_latitude"), lon=("o_longitude", "d_longitude"))
    return (
        ends.where("code IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy("code")
        .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("total_flights"))
    )


def airport_statistics(df: DataFrame) -> DataFrame:
    """Airports with coordinates and flights, busiest first."""
    return airport_counts(df).orderBy(F.desc("total_flights"), "code")


def first_by(value: Column | str, count: Column | str) -> Column:
    """Value with the greatest count; the first in order among equals."""
    count = F.col(count) if isinstance(count, str) else count
    return F.min_by(value, F.struct(-count, value))


def count_summary(airports: DataFrame) -> DataFrame:
    """Sum, mean, median, greatest (and whose), least number of flights."""
    n = F.col("total_flights")
    # Equal counts are merged first: the median then holds one entry per distinct count.
    merged = airports.groupBy("total_flights").agg(
        F.count("*").alias("airports"), F.min("code").alias("code"))
    return merged.agg(
        F.sum(n * F.col("airports")).cast("bigint").alias("total"),
        (F.sum(n * F.col("airports")).cast("double") / F.sum("airports")).alias("mean"),
        F.expr("percentile(total_flights, 0.5, airports)").alias("median"),
        F.max(n).alias("max"),
        F.max_by("code", n).alias("max_code"),
        F.min(n).alias("min"),
    )


def count_bins(airports: DataFrame, edges: Sequence[int] = COUNT_EDGES,
               labels: Sequence[str] = COUNT_LABELS) -> DataFrame:
    """Airports per right-closed bin with percent of all airports; empty bins are listed too."""
    n = F.col("total_flights")
    bins = list(zip(edges[:-1], edges[1:], labels))
    one_row = airports.agg(
        F.count("*").alias("all"),
        *[F.count_if((n > low) & (n <= high)).alias(f"b{i}") for i, (low, high, _) in enumerate(bins)],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("bin"),
            F.lit(label).alias("label"),
            F.col(f"b{i}").alias("airports"),
            (F.col(f"b{i}") * 100.0 / F.nullif(F.col("all"), F.lit(0))).alias("percent"),
        )
        for i, (_, _, label) in enumerate(bins)
    ]
    return one_row.select(F.inline(F.array(*rows)))
