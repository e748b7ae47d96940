"""One table from Parquet files whose schemas have drifted: renamed, widened and nested columns.

Files are told apart by what their footers state. All files of one schema are one scan, whose columns
are found by name, cast without loss and put together by name. A file that cannot be read so is left
out and listed with its reasons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airstats.sources.parquet import footer_schemas
from airstats.storage import stored

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
#: Digits that a whole number of each width may have.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
_PART = r"(/[^/=]+=[^/]*)*/[^/]+$"


def widens(found: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of one type has an equal one in the other, nested types part by part.

    A struct may have its fields in any order and more of them; one it lacks cannot be made up.
    """
    if found == wanted:
        return True
    if isinstance(wanted, T.ArrayType):
        return isinstance(found, T.ArrayType) and widens(found.elementType, wanted.elementType)
    if isinstance(wanted, T.MapType):
        return isinstance(found, T.MapType) and found.keyType == wanted.keyType and widens(found.valueType, wanted.valueType)
    if isinstance(wanted, T.StructType):
        if not isinstance(found, T.StructType):
            return False
        own = {f.name.lower(): f.dataType for f in found.fields}
        return all(f.name.lower() in own and widens(own[f.name.lower()], f.dataType) for f in wanted.fields)
    if found in _WHOLE:
        if wanted in _WHOLE:
            return _WHOLE.index(found) < _WHOLE.index(wanted)
        digits = _DIGITS[found.simpleString()]
        if isinstance(wanted, T.DecimalType):
            return wanted.precision - wanted.scale >= digits
        return isinstance(wanted, T.DoubleType) and digits <= 10 or isinstance(wanted, T.FloatType) and digits <= 5
    if isinstance(found, T.DecimalType) and isinstance(wanted, T.DecimalType):
        return wanted.scale >= found.scale and wanted.precision - wanted.scale >= found.precision - found.scale
    return (isinstance(found, T.FloatType) and isinstance(wanted, T.DoubleType)
            or isinstance(found, T.DateType) and isinstance(wanted, T.TimestampNTZType))


def _as(value: Column, found: T.DataType, wanted: T.DataType) -> Column:
    """A value in the type asked for; fields of structs are found by name."""
    if found == wanted:
        return value
    if isinstance(wanted, T.StructType):
        own = {f.name.lower(): f for f in found.fields}
        fields = [_as(value[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType).alias(f.name)
                  for f in wanted.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: _as(x, found.elementType, wanted.elementType))
    if isinstance(wanted, T.MapType):
        return F.transform_values(value, lambda _, x: _as(x, found.valueType, wanted.valueType))
    return value.cast(wanted)


class Drifted(NamedTuple):
    """The rows of all files that can be read, and ``file`` and ``faults`` of the others."""

    rows: DataFrame
    skipped: DataFrame


def _kinds(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``folder``, ``base`` and ``kind``, a digest of its columns, as a written table.

    The base is the folder above those named ``column=value``; a table below it is read as one.
    """
    columns = F.array_sort(F.collect_list(F.struct("column", "type")))
    files = footer_schemas(spark, path).groupBy("file").agg(columns.alias("columns"))
    base = F.regexp_replace("file", _PART, "")
    names = F.regexp_replace(F.regexp_extract("file", _PART, 0), "=[^/]*", "")
    return stored(files.select(
        "file", F.regexp_replace("file", "/[^/]+$", "").alias("folder"), base.alias("base"),
        F.sha2(F.to_json(F.struct("columns", F.regexp_replace(names, "/[^/]+$", "").alias("names"))), 256).alias("kind")),
        "kinds")


def _places(kinds: DataFrame) -> DataFrame:
    """``kind``, ``base`` and ``place``: whole bases where all files are of one kind, else whole folders, else files."""
    of_base = kinds.groupBy("base").agg(F.min("kind").alias("least"), F.max("kind").alias("most"))
    of_folder = kinds.groupBy("folder").agg(F.min("kind").alias("first"), F.max("kind").alias("last"))
    place = F.when(F.col("least") == F.col("most"), F.col("base")).when(
        F.col("first") == F.col("last"), F.col("folder")).otherwise(F.col("file"))
    return kinds.join(of_base, "base").join(of_folder, "folder").select("kind", "base", place.alias("place")).distinct()


def read_drifted(spark: SparkSession, path: str, schema: T.StructType,
                 names: Mapping[str, Sequence[str]] | None = None, optional: Sequence[str] = ()) -> Drifted:
    """Read a folder of Parquet files as ``schema``, whatever lossless way their own schemas differ from it.

    ``names`` gives other names that a column goes by in some files, tried in order after its own;
    letter case does not matter. A column in ``optional`` may be missing and is null then. A column that
    stands in the path, as ``column=value``, is read from there, also if the file has it too.

    One scan per distinct schema and base folder: the driver sees the schemas and, where files of several share a
    folder, the files of that folder; elsewhere it names folders. An empty folder gives no rows.
    """
    other = {k.lower(): [n.lower() for n in v] for k, v in (names or {}).items()}
    may_lack = {c.lower() for c in optional}
    kinds = _kinds(spark, path)
    scans: dict[tuple[str, str], list[str]] = {}
    for row in _places(kinds).toLocalIterator():
        scans.setdefault((row.kind, row.base), []).append(row.place)
    rows, faults_of = spark.createDataFrame([], schema), []
    for (kind, base), places in sorted(scans.items()):
        part = spark.read.option("basePath", base).parquet(*sorted(places))
        own = {f.name.lower(): f for f in part.schema.fields}
        columns, faults = [], []
        for f in schema.fields:
            name = next((n for n in (f.name.lower(), *other.get(f.name.lower(), [])) if n in own), None)
            if name is None and f.name.lower() not in may_lack:
                faults.append(f"{f.name}: missing")
            elif name is None:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif not widens(own[name].dataType, f.dataType):
                faults.append(f"{f.name}: {own[name].dataType.simpleString()}")
            else:
                columns.append(_as(F.col(f"`{own[name].name}`"), own[name].dataType, f.dataType).alias(f.name))
        faults_of.append((kind, base, faults))
        if not faults:
            rows = rows.unionByName(part.select(*columns))
    reasons = spark.createDataFrame(faults_of, "kind string, base string, faults array<string>").where(F.size("faults") > 0)
    return Drifted(rows, kinds.join(reasons, ["kind", "base"]).select("file", "faults"))
