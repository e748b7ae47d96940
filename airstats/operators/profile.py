"""Value profile of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value.
PROFILE_TOP = 15


def value_profile(df: DataFrame, cols: Sequence[str], top: int = PROFILE_TOP) -> DataFrame:
    """Per column the most frequent values with count, percent of all rows and cardinality.

    One scan and one shuffle of counts: the columns become (column, value) pairs, counted before
    the shuffle. The null group stays among the counts, its rows are part of the percentage base;
    it is ranked last and dropped after the ranking, so that both uses of the counts are the same.
    """
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    # One row per profiled column.
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("value").alias("cardinality"))
    order = Window.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), "value")
    # The constant bound lets Spark cut every task's part to ``top`` values before the shuffle.
    ranked = (
        counts.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= top) & F.col("value").isNotNull())
    )
    return ranked.join(F.broadcast(totals), "column").select(
        "column", "rank", "value", "n",
        F.round(F.col("n") * 100.0 / F.col("rows"), 2).alias("percent"),
        "cardinality",
    )
