"""Priority scores and stratified weighted sampling."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.functions import STRATA, Stratum, dep_hour, hash52, is_peak, key_text, uniform
from airstats.operators.rank import among
from airstats.storage import stored

# Points a flight gets, and the seed to which its month is added.
BASE_POINTS = 1.0
CARRIER_POINTS = 2.0
AIRPORT_POINTS = 1.5
PEAK_POINTS = 1.0
SAMPLE_SEED = 42

_ZERO_WEIGHT_BIN = 100_000
_BINS_PER_OCTAVE = 8


def priority_score(top_carriers: Column, top_airports: Column, time_format: str = "hhmm",
                   carrier: str = "op_carrier", origin: str = "origin", dest: str = "dest",
                   dep_time: str = "dep_time") -> Column:
    """Points for a large carrier, a large airport at either end and a peak hour."""
    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    return (
        F.lit(BASE_POINTS)
        + points(among(carrier, top_carriers), CARRIER_POINTS)
        + points(among(origin, top_airports) | among(dest, top_airports), AIRPORT_POINTS)
        + points(is_peak(dep_hour(dep_time, time_format)), PEAK_POINTS)
    )


def with_priority(df: DataFrame, top_carriers: Column, top_airports: Column,
                  time_format: str = "hhmm") -> DataFrame:
    return df.withColumn("priority_score", priority_score(top_carriers, top_airports, time_format))


def stratified_sample(df: DataFrame, by: Sequence[str], quota: Column, weight: Column | str,
                      key: str | Sequence[str], seed: int | Column = SAMPLE_SEED,
                      max_quota: int | None = None) -> DataFrame:
    """The drawn rows of :func:`counted_sample`."""
    return counted_sample(df, by, quota, weight, key, seed, max_quota).rows


class CountedSample(NamedTuple):
    """Drawn rows, not yet computed, and a written table of the rows there were to draw from, by stratum."""

    rows: DataFrame
    available: DataFrame


def counted_sample(df: DataFrame, by: Sequence[str], quota: Column, weight: Column | str,
                   key: str | Sequence[str], seed: int | Column = SAMPLE_SEED,
                   max_quota: int | None = None) -> CountedSample:
    """Draw up to ``quota`` rows per stratum without replacement, chances following ``weight``.

    Exponential race: every row gets -ln(u) / weight with u hashed from ``key``, and the smallest
    win; that is the distribution of drawing one row after the other in proportion to the weights
    left. A stratum no larger than its quota is taken whole. Rows of weight 0 (or NaN) only fill what is
    left, evenly, so a stratum with no weight at all is sampled evenly.

    ``key`` must be unique, and ``quota`` the same throughout a stratum; rows with a null in
    ``by`` belong to no stratum.

    A stratum may hold any part of the table, so rows are never sorted by stratum as they are.
    A first pass counts the race times of each stratum on a logarithmic scale (a few hundred
    counters a stratum, added up before the shuffle) and finds how far the scale must be read to
    fill the quota. A second pass drops all rows beyond that, and only the remaining few, the
    quota plus at most about a tenth, are shuffled and ranked. ``max_quota``, if known, also lets
    every task cut its own part to that many rows; that matters when a key has many copies, which
    all have the same race time.

    The counters also say how many rows each stratum has; rows without a stratum are counted there
    under their nulls and never drawn.
    """
    by = list(by)
    weight = F.col(weight) if isinstance(weight, str) else weight
    hit = -F.ln(uniform(hash52(key_text(key), seed)))
    runners = (
        df.withColumns({"_hit": hit, "_weight": F.nanvl(weight.cast("double"), F.lit(0.0)), "_quota": quota})
        .withColumn("_race", F.when(F.col("_weight") > 0, F.col("_hit") / F.col("_weight"))
                    .otherwise(float("inf")))
    )
    level = F.when(F.col("_weight") > 0, F.col("_race")).otherwise(F.col("_hit"))
    offset = F.when(F.col("_weight") > 0, 0).otherwise(_ZERO_WEIGHT_BIN)
    runners = runners.withColumn(
        "_bin", (F.floor(F.log2(level) * _BINS_PER_OCTAVE) + offset).cast("int"))

    counts = runners.groupBy(*by, "_bin").agg(
        F.count("*").alias("_n"), F.max("_quota").alias("_quota"))
    filled = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin"))
    last_bins = stored(
        counts.withColumn("_filled", filled)
        .groupBy(*by)
        .agg(F.min(F.when(F.col("_filled") >= F.col("_quota"), F.col("_bin"))).alias("_last_bin"),
             F.sum("_n").alias("available")),
        "last-bins",
    )

    place = F.row_number().over(Window.partitionBy(*by).orderBy("_race", "_hit", *_key_columns(key)))
    ranked = (
        runners.join(last_bins.select(*by, "_last_bin"), by)
        .where(F.col("_last_bin").isNull() | (F.col("_bin") <= F.col("_last_bin")))
        .withColumn("_place", place)
        .where(F.col("_place") <= F.col("_quota"))
    )
    if max_quota is not None:
        ranked = ranked.where(F.col("_place") <= max_quota)
    return CountedSample(ranked.select(*df.columns), last_bins.select(*by, "available"))


def _key_columns(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sampling_log(available: DataFrame, sample: DataFrame, month: str = "month",
                 group: str = "delay_group", strata: tuple[Stratum, ...] = STRATA) -> DataFrame:
    """Available and sampled rows per month and group; empty groups of a present month show 0.

    ``available`` has the rows per month and group that the sampler counted while it drew, so the
    population is not read for it.
    """
    both = available.select(month, group, "available", F.lit(0).cast("long").alias("_drawn")).unionByName(
        sample.select(month, group, F.lit(0).cast("long").alias("available"), F.lit(1).cast("long").alias("_drawn")))

    def of(column: str, s: Stratum) -> Column:
        return F.sum(F.when(F.col(group) == s.name, F.col(column)).otherwise(0))

    per_month = both.where(F.col(month).isNotNull()).groupBy(month).agg(
        *[of("available", s).alias(f"a_{s.name}") for s in strata],
        *[of("_drawn", s).alias(f"s_{s.name}") for s in strata],
    )
    rows = [
        F.struct(F.lit(s.name).alias("delay_group"), F.col(f"a_{s.name}").alias("available"),
                 F.col(f"s_{s.name}").alias("sampled"))
        for s in strata
    ]
    return per_month.select(F.col(month).alias("month"), F.inline(F.array(*rows)))


def group_shares(sample: DataFrame, group: str = "delay_group",
                 strata: tuple[Stratum, ...] = STRATA) -> DataFrame:
    """Rows and share of each group in the sample, largest first."""
    one_row = sample.agg(
        F.count(group).alias("all"), *[F.count_if(F.col(group) == s.name).alias(s.name) for s in strata])
    rows = [
        F.struct(F.lit(s.name).alias("delay_group"), F.col(s.name).alias("n"),
                 (F.col(s.name).cast("double") / F.nullif(F.col("all"), F.lit(0))).alias("share"))
        for s in strata
    ]
    return one_row.select(F.inline(F.array(*rows))).where("n > 0").orderBy(F.desc("n"), "delay_group")


def carrier_coverage(sample: DataFrame, top_carriers: Column, carrier: str = "op_carrier") -> DataFrame:
    """Share of sampled rows flown by one of the top carriers."""
    return sample.agg(F.avg(among(carrier, top_carriers).cast("int")).alias("coverage"))
