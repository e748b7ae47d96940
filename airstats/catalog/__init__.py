"""Every operator as a query over the given tables, most with the same result as SQL text."""

from airstats.catalog.registry import QUERIES, SQL

from airstats.catalog import files, models, relational  # noqa: F401  (fills the registry)

__all__ = ["QUERIES", "SQL"]
