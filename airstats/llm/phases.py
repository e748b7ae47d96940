"""Steps of an operator that end with a stored table."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from airstats.storage import scratch_path


def finished(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, and the shuffle files of the step removed from the executors' disks.

    The table is written to the shared folder, so a lost executor costs a re-read. Spark removes
    shuffle files once the driver has collected the plans that used them, which a driver with
    little to do may put off until the disks are full.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
