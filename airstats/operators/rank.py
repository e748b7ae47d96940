"""Most frequent values, grouping of the rest, ranking of routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
TOP_CARRIERS = 10
TOP_AIRPORTS = 20
SURVEYED_MONTHS = (1, 7)
OTHER = "OTHER"


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How often each value occurs in any of ``cols``, in one scan; nulls are not counted."""
    value = F.col(cols[0]) if len(cols) == 1 else F.explode(F.array(*cols))
    return df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(
        F.count("*").alias("n"))


def top_values(df: DataFrame, cols: Sequence[str], k: int,
               months: Sequence[int] | None = None) -> DataFrame:
    """The ``k`` most frequent values, ties in order of the value."""
    if months is not None:
        df = df.where(F.col("month").isin(*months))
    return value_counts(df, cols).orderBy(F.desc("n"), "value").limit(k)


def as_list(top: DataFrame) -> Column:
    """The values of a top-k table as one array for use in expressions over other tables.

    ``top`` is cut to a constant number of rows, which bounds the array.
    """
    return top.agg(F.collect_list("value")).scalar()


def among(c: Column | str, values: Column) -> Column:
    """Whether a value is in an array; null is not."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_contains(values, c), F.lit(False))


def keep_or_other(c: Column, top: Column) -> Column:
    return F.when(among(c, top), c).otherwise(OTHER)


def group_other(df: DataFrame, col: str, k: int = TOP_AIRPORTS, out: str | None = None) -> DataFrame:
    """Keep the ``k`` most frequent values of a column and call the rest OTHER.

    A missing value is the text ``nan`` and can itself be among the most frequent.
    """
    from airstats.functions import code_text

    text = code_text(col)
    top = as_list(top_values(df.select(text.alias(col)), [col], k))
    return df.withColumn(out or f"{col}_grouped", keep_or_other(text, top))


def route_ranking(df: DataFrame, min_flights: int = 1, delay: str = "total_delay",
                  origin: str = "origin", dest: str = "dest") -> DataFrame:
    """Routes by mean delay, worst first; routes with few flights left out."""
    return (
        df.where(F.col(origin).isNotNull() & F.col(dest).isNotNull())
        .groupBy(origin, dest)
        .agg(F.avg(delay).alias("route_risk"), F.count("*").alias("flights"))
        .where(F.col("flights") >= min_flights)
        .orderBy(F.desc("route_risk"), origin, dest)
    )
