"""From flights to the representative sample, and from both to the validation tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.functions import STRATA, delay_group, quota_of
from airstats.operators import compare, filters, rank, strata
from airstats.storage import stored


class Sampled(NamedTuple):
    sample: DataFrame
    log: DataFrame
    shares: DataFrame
    coverage: DataFrame


def frequent(df: DataFrame) -> tuple[Column, Column]:
    """The most frequent carriers and airports of the surveyed months, as arrays for expressions.

    Both come from one scan and are kept as a written table of 30 rows, which every later pass
    over the flights reads instead of counting again.
    """
    def entry(kind: str, col: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))

    surveyed = df.where(F.col("month").isin(*rank.SURVEYED_MONTHS))
    counts = (
        surveyed.select(F.inline(F.array(
            entry("carrier", "op_carrier"), entry("airport", "origin"), entry("airport", "dest"))))
        .where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    top = stored(
        counts.withColumn("place", place)
        .where(F.col("place") <= max(rank.TOP_CARRIERS, rank.TOP_AIRPORTS))
        .where((F.col("kind") == "airport") & (F.col("place") <= rank.TOP_AIRPORTS)
               | (F.col("kind") == "carrier") & (F.col("place") <= rank.TOP_CARRIERS)),
        "frequent",
    )
    return rank.as_list(top.where("kind = 'carrier'")), rank.as_list(top.where("kind = 'airport'"))


def with_strata(df: DataFrame, time_format: str = "hhmm",
                top: tuple[Column, Column] | None = None) -> DataFrame:
    """Flights with priority score and delay group; ``top`` is the result of ``frequent``, if at hand."""
    carriers, airports = top or frequent(df)
    return strata.with_priority(df, carriers, airports, time_format).withColumn(
        "delay_group", delay_group("arr_delay"))


def draw(scored: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The stratified sample of flights that carry a priority score and a delay group."""
    return draw_counted(scored, key).rows


def draw_counted(scored: DataFrame, key: str | Sequence[str]) -> strata.CountedSample:
    """As :func:`draw`, with the rows available per month and delay group, which the sampler has counted."""
    return strata.counted_sample(
        scored, ["month", "delay_group"], quota_of("delay_group"), "priority_score", key,
        F.lit(strata.SAMPLE_SEED) + F.col("month"), max(s.quota for s in STRATA))


def sample_flights(df: DataFrame, key: str | Sequence[str], time_format: str = "hhmm") -> Sampled:
    """Draw the sample, write it to the scratch folder and report on it."""
    top = frequent(df)
    population = with_strata(df, time_format, top)
    drawn = draw_counted(population, key)
    sample = stored(drawn.rows.drop("priority_score").withColumn("sampling_month", F.col("month")), "sample")
    return Sampled(
        sample,
        strata.sampling_log(drawn.available, sample),
        strata.group_shares(sample),
        strata.carrier_coverage(sample, top[0]),
    )


class Validation(NamedTuple):
    carriers: DataFrame
    carrier_chart: DataFrame
    airport_chart: DataFrame
    hour_chart: DataFrame
    peak: DataFrame
    missing: DataFrame


def validate_sample(population: DataFrame, sample: DataFrame, time_format: str = "hhmm") -> Validation:
    """How well a sample stands for its population. Each table is one narrow pass over either side."""
    return Validation(
        compare.share_compare(population, sample, "op_carrier"),
        compare.share_chart(population, sample, "op_carrier"),
        compare.topk_share_compare(population, sample),
        compare.hour_distribution(population, sample, time_format=time_format),
        compare.peak_compare(population, sample, time_format=time_format),
        filters.temporal_coverage(sample),
    )
