"""Load CSV files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airstats.sources.csv import READ_OPTIONS, header_names, line_schema
from airstats.sources.parquet import (
    accounted, counts_of_outcomes, flights_of, loaded_years, record_load, write_partitioned, write_quarantine,
)

STREAM_PARTITIONS = ("year", "month", "load")
FILES_PER_LOAD = 1000
# Columns that tell one flight from another.
FLIGHT_KEY = ("FL_DATE", "OP_CARRIER", "OP_CARRIER_FL_NUM", "ORIGIN", "DEST", "CRS_DEP_TIME")


def flight_lines(spark: SparkSession, src: str, files_per_load: int = FILES_PER_LOAD) -> DataFrame:
    """A stream of the lines of CSV files in a folder, broken lines marked."""
    return (
        spark.readStream.schema(line_schema(header_names(spark, src)))
        .options(**READ_OPTIONS, maxFilesPerTrigger=files_per_load)
        .csv(src)
    )


def new_flights(rows: DataFrame, table: str, load: str, key: Sequence[str] = FLIGHT_KEY) -> DataFrame:
    """One row for each key of ``rows`` that no other load of ``table`` has.

    A flight's key holds its date, so only the months that occur in ``rows`` are searched: the table is
    partitioned by them. Partitions of ``load`` itself do not count, it may be under way again. Rows
    with a null in the key are told apart by what they have of it.
    """
    spark = rows.sparkSession
    names = [k for k in key if k.lower() in (c.lower() for c in rows.columns)]
    once = rows.dropDuplicates(names).withColumn("_key", F.struct(*names))
    months = [(r.year, r.month) for r in rows.select("year", "month").distinct().collect()]
    if not months:
        return once.drop("_key")
    touched = reduce(lambda a, b: a | b, [(F.col("year") == y) & (F.col("month") == m) for y, m in months])
    if not loaded_years(spark, table):
        return once.drop("_key")
    there = spark.read.parquet(table).where(touched & (F.col("load") != load)).select(F.struct(*names).alias("_there"))
    return once.join(there, F.col("_key").eqNullSafe(F.col("_there")), "left_anti").drop("_key")


def stream_ingest(spark: SparkSession, src: str, dst: str, checkpoint: str,
                  files_per_load: int = FILES_PER_LOAD, feed: str | None = None, quarantine: str | None = None,
                  loads: str | None = None, key: Sequence[str] | None = None) -> StreamingQuery:
    """Load all files not loaded yet into ``dst`` and stop.

    Each micro-batch writes partitions of its own, ``year=/month=/load=<feed>-<batch>``, and replaces
    them when it is repeated after a failure; so every row arrives once, and a year may be spread
    over any number of loads. Batches are numbered within a checkpoint, so a table that several
    feeds write to tells them apart by ``feed``, which follows from the checkpoint's path unless
    it is given.

    With a ``key`` (such as ``FLIGHT_KEY``) a flight that was delivered before, or twice, is loaded once.
    Lines that cannot be loaded go to the folder ``quarantine``, line counts to the book of ``loads``;
    both are written by the batch and replaced with it. A batch is parsed once for all of them.
    """
    feed = feed or md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def load(batch: DataFrame, batch_id: int) -> None:
        name = f"{feed}-{batch_id}"
        rows, counted = accounted(batch), Observation()
        several = quarantine is not None or key is not None
        if several:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        watched = rows.observe(counted, *counts_of_outcomes())
        flights = flights_of(watched if key is None else rows)
        if key is not None:
            watched.write.format("noop").mode("overwrite").save()
            flights = new_flights(flights, dst, name, key)
        write_partitioned(flights.withColumn("load", F.lit(name)), dst, STREAM_PARTITIONS, mode="replace")
        if quarantine is not None:
            write_quarantine(rows, quarantine, name)
        if loads is not None:
            record_load(batch.sparkSession, loads, src, counted.get, name)
        if several:
            rows.unpersist()

    return (
        flight_lines(spark, src, files_per_load).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
