"""Delay strata for sampling and delay levels for modelling. Their cutoffs differ on purpose."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from airstats.functions.parse import _col


class Stratum(NamedTuple):
    """Delays in (low, high] minutes, and how many flights to draw a month."""

    name: str
    low: float
    high: float
    quota: int


# Fixed values.
STRATA = (
    Stratum("Severe", 60, 99999, 50),
    Stratum("Moderate", 30, 60, 100),
    Stratum("Minor", 0, 30, 150),
    Stratum("OnTime", -999, 0, 200),
)
DELAY_LEVELS = ((0, 0), (45, 1), (90, 2))
LAST_DELAY_LEVEL = 3


def delay_group(minutes: Column | str, strata: tuple[Stratum, ...] = STRATA) -> Column:
    """Name of the stratum a delay falls in; null outside all of them."""
    m = _col(minutes)
    group = F.lit(None).cast("string")
    for s in reversed(strata):
        group = F.when((m > s.low) & (m <= s.high), s.name).otherwise(group)
    return group


def quota_of(group: Column | str, strata: tuple[Stratum, ...] = STRATA) -> Column:
    g = _col(group)
    quota = F.lit(0)
    for s in strata:
        quota = F.when(g == s.name, s.quota).otherwise(quota)
    return quota


def delay_level(minutes: Column | str) -> Column:
    """0 on time, 1 up to 45 minutes, 2 up to 90, 3 above (and for unknown minutes)."""
    m = _col(minutes)
    first, *rest = DELAY_LEVELS
    level = F.when(m <= first[0], first[1])
    for upper, code in rest:
        level = level.when(m <= upper, code)
    return level.otherwise(LAST_DELAY_LEVEL)
