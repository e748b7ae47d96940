"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="airstats-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nothing has used yet."""
    return f"{scratch_dir(spark)}/airstats/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a re-computation, and gives
    Catalyst the true size on disk: a join against the result is broadcast only if that size is
    below ``spark.sql.autoBroadcastJoinThreshold``, else it is a shuffle join under AQE.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the folders of a table that :func:`stored` has written and that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of plans that are done with, which Spark does once the driver has collected these."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a stored table that has fewer partitions than there are cores.

    For steps that compute much on little data. A table of any size has more partitions than
    that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
