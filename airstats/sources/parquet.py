"""Partitioned Parquet: write, load by year, list, ledger, footers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from hashlib import md5
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from airstats.operators.filters import require, with_year_month
from airstats.schema import ESSENTIAL
from airstats.sources.csv import BAD_COLUMNS, LINE, flight_lines, judged
from airstats.storage import scratch_path

PARTITIONS = ("year", "month")
ROWS_PER_FILE = 5_000_000
LEDGER_SCHEMA = T.StructType([
    T.StructField("processing_date", T.StringType()),
    T.StructField("processed_years", T.ArrayType(T.IntegerType())),
    T.StructField("total_rows", T.LongType()),
    T.StructField("file_sizes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("last_updated", T.StringType()),
])


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = PARTITIONS, mode: str = "append") -> None:
    """Snappy Parquet below ``year=/month=``.

    ``mode="replace"`` replaces just the partitions that occur in ``df``. Rows are rebalanced by
    partition, so a month is written by few tasks, and AQE splits a month larger than the
    advisory size among several.
    """
    writer = df.hint("rebalance", *by).write.partitionBy(*by).option("compression", "snappy").option(
        "maxRecordsPerFile", ROWS_PER_FILE)
    if mode == "replace":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)


def prepared(good: DataFrame) -> DataFrame:
    """Flights with all essential columns, with year and month read from the date.

    The month of the date takes the place of a MONTH column: Spark does not tell names apart by
    letter case, and a partitioned table can hold the name but once.
    """
    kept = require(good)
    dated = with_year_month(kept.drop("month"), "FL_DATE")
    return dated.where(F.col("year").isNotNull() & F.col("month").isNotNull())


# What becomes of a line: it is loaded, has a value that cannot be read, lacks an essential column or its date,
# or is of a year that was not asked for.
LOADED, REJECTED, DROPPED, OTHER_YEAR = "loaded", "rejected", "dropped", "other_year"
OUTCOMES = (LOADED, REJECTED, DROPPED, OTHER_YEAR)


def accounted(lines: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """All lines of flights, typed, with year, month and ``outcome``."""
    dated = with_year_month(judged(lines).drop("month"), "FL_DATE")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*ESSENTIAL, "year", "month")])
    wanted = F.lit(True) if years is None else F.col("year").isin(*years)
    return dated.withColumn("outcome", F.when(F.col(BAD_COLUMNS).isNotNull(), REJECTED).when(missing, DROPPED)
                            .when(wanted, LOADED).otherwise(OTHER_YEAR))


def counts_of_outcomes() -> list[Column]:
    """Lines, and lines of each outcome, to be observed while rows pass."""
    return [F.count("*").alias("lines"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]]


def flights_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`accounted` that are loaded, as flights."""
    return rows.where(F.col("outcome") == LOADED).drop(LINE, BAD_COLUMNS, "outcome")


def write_quarantine(rows: DataFrame, path: str, load: str) -> None:
    """Rejected and dropped lines of a load, by load and outcome; a load that is repeated replaces its own.

    A rejected line is kept as it was read, a dropped one is written anew from its values.
    """
    values = [c for c in rows.columns if c not in (LINE, BAD_COLUMNS, "outcome", "year", "month")]
    kept = rows.where(F.col("outcome").isin(REJECTED, DROPPED)).select(
        F.coalesce(LINE, F.to_csv(F.struct(*values))).alias("line"), F.col(BAD_COLUMNS).alias("bad_columns"),
        F.lit(load).alias("load"), "outcome")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "outcome").parquet(path)


def loaded_years(spark: SparkSession, path: str) -> set[int]:
    """Years a table has files of; none if there is no table yet. Lists folders, opens no file."""
    found = set()
    for folder in subfolders(spark, path):
        name, _, value = folder.rpartition("/")[2].partition("=")
        if name == "year" and value.isdigit() and any(_files_by_folder(spark, path, [int(value)]).values()):
            found.add(int(value))
    return found


class Load(NamedTuple):
    """The years a load wrote, and the lines it read by what became of them (None if it had nothing to do)."""

    years: list[int]
    counts: dict[str, int] | None


def load(spark: SparkSession, src: str | Sequence[str], dst: str, years: Sequence[int], force: bool = False,
         quarantine: str | None = None) -> Load:
    """Load the CSV rows of ``years`` that are not in the table.

    ``force`` loads a year again: its months are replaced, and months that the source no longer has
    go once the others are written; other years stay untouched. All years come from one scan of
    the source and are committed together; the same scan counts what becomes of every line. Lines
    that cannot be loaded go to the folder ``quarantine``; for them the typed lines are kept in the
    scratch folder until the load is done, so that the source is still read and typed once.
    """
    todo = sorted(set(years) if force else set(years) - loaded_years(spark, dst))
    if not todo:
        return Load(todo, None)
    before = _files_by_folder(spark, dst, todo) if force else {}
    rows = accounted(flight_lines(spark, src), todo)
    counted, typed = Observation(), None
    rows = rows.observe(counted, *counts_of_outcomes())
    if quarantine is not None:
        typed = scratch_path(spark, "typed")
        rows.write.parquet(typed)
        rows = spark.read.schema(rows.schema).parquet(typed)
    write_partitioned(flights_of(rows), dst, mode="replace")
    after = _files_by_folder(spark, dst, todo) if force else {}
    # a folder that the load wrote has other files than before
    _delete(spark, [folder for folder, files in after.items() if before.get(folder) == files])
    counts = counted.get
    if quarantine is not None and counts[REJECTED] + counts[DROPPED]:
        sources = [src] if isinstance(src, str) else list(src)
        write_quarantine(rows, quarantine, md5("\n".join([*sources, *map(str, todo)]).encode()).hexdigest()[:12])
    if typed is not None:
        _delete(spark, [typed])
    return Load(todo, counts)


def load_years(spark: SparkSession, src: str | Sequence[str], dst: str, years: Sequence[int],
               force: bool = False, quarantine: str | None = None) -> list[int]:
    """As :func:`load`; returns the years loaded."""
    return load(spark, src, dst, years, force, quarantine).years


def record_load(spark: SparkSession, path: str, source: str, counts: Mapping[str, int], load: str | None = None) -> None:
    """Add a load's line counts to the book of loads. A load that is given by name replaces its own entry."""
    row = {"source": source, "load": load or uuid.uuid4().hex[:12], **{k: counts[k] for k in ("lines", *OUTCOMES)}}
    kinds = ", ".join(["source string", "load string", *[f"{k} long" for k in ("lines", *OUTCOMES)]])
    spark.createDataFrame([tuple(row.values())], kinds).withColumn("at", F.current_timestamp()).coalesce(1).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in a folder; none if it is not there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in files.listStatus(root) if f.isDirectory()] if files.exists(root) else []


def has_files(spark: SparkSession, path: str, name: str) -> bool:
    """Whether a folder has a file of that name."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def _files_by_folder(spark: SparkSession, table: str, years: Sequence[int]) -> dict[str, frozenset[str]]:
    """Data files in each month's folder of some years of a table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for year in years:
        folder = jvm.org.apache.hadoop.fs.Path(root, f"year={year}")
        if not files.exists(folder):
            continue
        for month in files.listStatus(folder):
            if month.isDirectory():
                found[month.getPath().toString()] = frozenset(
                    f.getPath().getName() for f in files.listStatus(month.getPath()))
    return found


def _delete(spark: SparkSession, folders: Sequence[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _per_file(rows: DataFrame) -> DataFrame:
    """Year, path, bytes and rows of each data file."""
    return rows.groupBy(
        "year", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count("*").alias("rows"))


def _listed(files: DataFrame) -> DataFrame:
    return files.groupBy("year").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def partition_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files, rows and bytes per year, counted in full."""
    return _listed(_per_file(spark.read.parquet(path)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(path)


def update_ledger(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Write the one-row ledger of a table: years, rows, sizes, first and last processing time."""
    return _write_ledger(partition_listing(spark, table), path)


def merge_ledger(spark: SparkSession, table: str, path: str, book: str, years: Sequence[int]) -> DataFrame:
    """As :func:`update_ledger`, after a load that wrote ``years``: only their files are counted.

    ``book`` is a table of one row per year (files, rows, bytes). The years that a load wrote
    replace their rows there, a year that has no files left is kept as 0 rows and not listed, and
    the ledger is made from the book. The first call for a table must name all its years
    (:func:`loaded_years`). Merging the same load again changes nothing but ``last_updated``.
    """
    there = loaded_years(spark, table)
    found = spark.createDataFrame([(y,) for y in sorted(set(years))], "year int")
    if there & set(years):
        paths = [f"{table}/year={y}" for y in sorted(there & set(years))]
        found = found.join(_listed(_per_file(spark.read.option("basePath", table).parquet(*paths))), "year", "left")
    else:
        found = found.selectExpr("year", *[f"0L AS {c}" for c in ("files", "rows", "bytes")])
    found.na.fill(0).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year").parquet(book)
    return _write_ledger(spark.read.parquet(book).where("files > 0"), path)


def _write_ledger(listing: DataFrame, path: str) -> DataFrame:
    spark = listing.sparkSession
    try:
        first = ledger(spark, path).select("processing_date").head()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        first = None
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    gigabytes = F.format_string("%.2fGB", F.col("bytes") / float(1024**3))
    # One group per year is left when the lists are built.
    row = listing.agg(
        F.array_sort(F.collect_list("year")).alias("processed_years"),
        F.sum("rows").alias("total_rows"),
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), gigabytes))).alias("file_sizes"),
    ).select(
        (now if first is None else F.lit(first.processing_date)).alias("processing_date"),
        "processed_years", "total_rows", "file_sizes", now.alias("last_updated"),
    )
    row.write.mode("overwrite").json(path)
    return ledger(spark, path)


def footer_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Column names and types as each Parquet file states them: (file, column, type)."""
    # A nested function travels to the workers by value: they need not have this package.
    def schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for file in batch["file"]:
                # Hadoop writes file:/x where Arrow expects file:///x.
                local = file.startswith("file:/") and not file.startswith("file://")
                place = "file://" + file[5:] if local else file
                if place.startswith(("s3a://", "s3n://")):
                    place = "s3" + place[3:]
                filesystem, inner = fs.FileSystem.from_uri(place)
                schema = pq.read_schema(inner, filesystem=filesystem)
                yield pd.DataFrame({"file": file, "column": schema.names, "type": [str(t) for t in schema.types]})

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    )
    return files.mapInPandas(schemas, "file string, column string, type string")


def type_profile(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """The types each column has in the files of a table, and in how many files."""
    wanted = [c.lower() for c in cols]
    return (
        footer_schemas(spark, path).where(F.lower("column").isin(*wanted))
        .groupBy(F.lower("column").alias("column"), "type").agg(F.count("*").alias("files"))
    )


def _footer_types(kind: T.DataType) -> tuple[str, ...]:
    """Types in footers that Spark reads as ``kind``; ValueError if there is no rule for it."""
    units = ("ms", "us", "ns")
    simple = {
        "string": ("string", "large_string"), "binary": ("binary", "large_binary"),
        "tinyint": ("int8",), "smallint": ("int8", "int16"), "int": ("int8", "int16", "int32"),
        "bigint": ("int8", "int16", "int32", "int64"), "float": ("float",), "double": ("float", "double"),
        "boolean": ("bool",), "date": ("date32[day]",),
        # the old 96-bit times have no zone in footers
        "timestamp": (*(f"timestamp[{u}, tz=UTC]" for u in units), "timestamp[ns]"),
        "timestamp_ntz": tuple(f"timestamp[{u}]" for u in units),
    }
    if isinstance(kind, T.DecimalType):
        return tuple(f"decimal128({p}, {kind.scale})" for p in range(1, kind.precision + 1))
    if kind.simpleString() not in simple:
        raise ValueError(f"no rule which files hold {kind.simpleString()}")
    return simple[kind.simpleString()]


def _files_by_fit(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Each file with the columns of ``schema`` that its path below ``path`` names, and the faults of the others.

    A column that stands in the path is read from there, whether or not the file has it too.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    below = F.lower(F.substr("file", F.lit(len(root) + 1)))
    named, faults = [], []
    for f in schema.fields:
        own = F.lower("column") == f.name.lower()
        in_path = F.bool_or(below.contains(f"/{f.name.lower()}="))
        fits = F.bool_or(own & F.col("type").isin(*_footer_types(f.dataType)))
        other = F.max(F.when(own, F.col("type")))
        named.append(F.when(in_path, F.lit(f.name)))
        faults.append(F.when(~in_path & ~fits, F.concat(F.lit(f"{f.name}: "), F.coalesce(other, F.lit("missing")))))
    return footer_schemas(spark, path).groupBy("file").agg(
        F.array_compact(F.array(*named)).alias("named"), F.array_compact(F.array(*faults)).alias("faults"))


def conforming_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that have all columns of ``schema`` in a type Spark reads as the one asked for.

    A column may also be a partition column, which stands in the file's path.
    """
    return _files_by_fit(spark, path, schema).where(F.size("faults") == 0).select("file", "named")


def skipped_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that do not conform to ``schema``, and why: columns that are missing or of another type."""
    return _files_by_fit(spark, path, schema).where(F.size("faults") > 0).select("file", "faults")


def read_conforming(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read the files of a folder that conform to ``schema``; skip those that do not.

    Partition columns of the folder may be part of the schema; files that have them in their paths and
    files that have them as columns are read side by side. The driver sees file names only, as it does for any scan.
    """
    by_named: dict[tuple[str, ...], list[str]] = {}
    for row in conforming_files(spark, path, schema).toLocalIterator():
        by_named.setdefault(tuple(row.named), []).append(row.file)
    out = spark.createDataFrame([], schema)
    for i, (named, files) in enumerate(sorted(by_named.items())):
        reader = spark.read.schema(schema)
        part = (reader.option("basePath", path) if named else reader).parquet(*files).select(*schema.names)
        out = part if i == 0 else out.unionByName(part)
    return out
