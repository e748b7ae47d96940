"""Expressions behind report figures and shown results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airstats.functions.parse import _col

# Texts shown for class 0, class 1 and every other class; marker scale factors.
CLASS_TEXTS = ("Đúng giờ", "Delay nhẹ", "Delay nặng")
MARKER_FACTOR = 8.0
SMALL_MARKER_FACTOR = 3.0


def argmax(values: Column | str) -> Column:
    """Zero-based place of the first greatest element of an array."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def class_text(cls: Column | str) -> Column:
    c = _col(cls)
    on_time, mild, heavy = CLASS_TEXTS
    return F.when(c == 0, on_time).when(c == 1, mild).otherwise(heavy)


def winning_percent(probabilities: Column | str) -> Column:
    """Probability of the winning class as a whole percent, halves rounded up."""
    return F.floor(F.array_max(_col(probabilities)) * 100 + 0.5).cast("int")


def marker_size(count: Column | str, factor: float = MARKER_FACTOR) -> Column:
    return F.sqrt(_col(count)) * factor


def share_of(part: Column, whole: Column) -> Column:
    """part / whole as double, null when the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
