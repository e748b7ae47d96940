"""Names, functions and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airstats.binding import FLIGHTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (session, table folder); ``sql`` may use the CTE ``flights``.

    Further CTEs of the SQL come first, separated by ``---`` from the final SELECT.
    """
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ctes, _, body = sql.rpartition("---")
            SQL[name] = "WITH " + FLIGHTS_SQL.strip() + (", " + ctes.strip() if ctes.strip() else "") + "\n" + body.strip()
        return fn
    return add
