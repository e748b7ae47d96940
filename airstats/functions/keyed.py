"""Random numbers that depend on a row's key alone, never on its partition or on a retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

HASH_BITS = 52


def key_text(key: str | Sequence[str]) -> Column:
    """One text for a key of one or more columns."""
    names = [key] if isinstance(key, str) else list(key)
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def hash52(text: Column, seed: int | Column) -> Column:
    """The leading 52 bits of md5(seed|text) as a whole number."""
    salt = (F.lit(seed) if isinstance(seed, int) else seed).cast("string")
    digest = F.md5(F.concat(salt, F.lit("|"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def uniform(h: Column) -> Column:
    """A hash as a number strictly between 0 and 1."""
    return (h.cast("double") + 0.5) / float(2**HASH_BITS)
