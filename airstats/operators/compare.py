"""Comparison of a sample with its population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airstats.functions import dep_hour, is_peak
from airstats.operators.rank import TOP_AIRPORTS

# Fixed values.
POPULATION, SAMPLE = "Population", "Sample"
COMPARED_CARRIERS = 5


def shares(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Count and share of each non-null value. The total is read off the counted rows."""
    value = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(value.alias(name)).where(F.col(name).isNotNull())
        .groupBy(name).agg(F.count("*").alias("n"))
    )
    return counts.withColumn("share", F.col("n").cast("double") / counts.agg(F.sum("n")).scalar())


def share_compare(population: DataFrame, sample: DataFrame, col: str, how: str = "inner",
                  top: int | None = COMPARED_CARRIERS) -> DataFrame:
    """Shares side by side with their absolute difference, by population share.

    The inner join leaves out values that occur on one side only; ``how="full"`` shows them as 0.
    """
    pop = shares(population, col, col).select(col, F.col("share").alias("share_pop"))
    sam = shares(sample, col, col).select(col, F.col("share").alias("share_sample"))
    joined = pop.join(sam, col, how)
    if how != "inner":
        joined = joined.fillna(0.0, ["share_pop", "share_sample"])
    ranked = joined.withColumn("diff", F.abs(F.col("share_pop") - F.col("share_sample"))).orderBy(
        F.desc("share_pop"), col)
    return ranked if top is None else ranked.limit(top)


def share_chart(population: DataFrame, sample: DataFrame, col: str) -> DataFrame:
    """Shares of both sides, one below the other."""
    return _labelled(shares(population, col, col), POPULATION).unionByName(
        _labelled(shares(sample, col, col), SAMPLE))


def topk_share_compare(population: DataFrame, sample: DataFrame, col: str = "origin",
                       k: int = TOP_AIRPORTS) -> DataFrame:
    """Shares within the population's ``k`` most frequent values, on both sides."""
    counts = (
        population.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), col).limit(k)
    )
    pop = counts.withColumn("share", F.col("n").cast("double") / counts.agg(F.sum("n")).scalar())
    # The list ends in a constant limit, so its broadcast is bounded by k rows.
    within = sample.join(F.broadcast(counts.select(col)), col, "left_semi")
    return _labelled(pop, POPULATION).unionByName(_labelled(shares(within, col, col), SAMPLE))


def hour_distribution(population: DataFrame, sample: DataFrame, dep_time: str = "dep_time",
                      time_format: str = "hhmm") -> DataFrame:
    """Share of flights by departure hour, both sides, in order of the hour."""
    hour = dep_hour(dep_time, time_format)
    return _labelled(shares(population, hour, "hour"), POPULATION).unionByName(
        _labelled(shares(sample, hour, "hour"), SAMPLE)).orderBy("type", "hour")


def peak_compare(population: DataFrame, sample: DataFrame, dep_time: str = "dep_time",
                 time_format: str = "hhmm") -> DataFrame:
    """Share of peak-hour flights on both sides and the absolute difference."""
    ratio = F.avg(is_peak(dep_hour(dep_time, time_format)).cast("int"))
    sides = population.agg(ratio.alias("peak_pop")).withColumn("peak_sample", sample.agg(ratio).scalar())
    return sides.withColumn("diff", F.abs(F.col("peak_pop") - F.col("peak_sample")))


def _labelled(df: DataFrame, side: str) -> DataFrame:
    return df.drop("n").withColumn("type", F.lit(side))
