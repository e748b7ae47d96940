"""Typed CSV scan with null texts and rejected rows, and the CSV sink."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airstats.schema import FLIGHT_SCHEMA, NULL_TOKENS

BROKEN_LINE = "_broken_line"
BAD_COLUMNS = "_bad_columns"
LINE = "_line"

# Quotes inside a quoted field are doubled, in files read as in files written.
DIALECT = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}
# Every file's header line must name the columns the first one does, in that order.
READ_OPTIONS = {
    **DIALECT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN_LINE, "enforceSchema": False}


class CsvScan(NamedTuple):
    """``good`` rows in the asked types, and ``rejects``: line and names of the columns at fault."""

    good: DataFrame
    rejects: DataFrame


def header_names(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names in a file's header line. No data is read."""
    return spark.read.options(**DIALECT).csv(path).columns


def line_schema(names: Sequence[str], schema: T.StructType = FLIGHT_SCHEMA) -> T.StructType:
    """Types of a file's columns, in its order, and a place for lines that do not fit them.

    A column the schema does not know is text.
    """
    types = {f.name: f.dataType for f in schema.fields}
    return T.StructType([
        *[T.StructField(n, types.get(n, T.StringType())) for n in names],
        T.StructField(BROKEN_LINE, T.StringType()),
    ])


def _is_number(field: T.StructField) -> bool:
    return not isinstance(field.dataType, T.StringType)


def _faults(schema: T.StructType, null_tokens: Sequence[str]) -> Column:
    """Names of the columns at fault in a line that could not be read in the types of ``schema``.

    A number that is missing although its text is there is a fault, unless that text means null;
    a line with too many or too few fields is one as a whole.
    """
    def named(fields: Sequence[T.StructField], data_type: str | None = None) -> Column:
        ddl = ", ".join(f"`{f.name}` {data_type or f.dataType.simpleString()}" for f in fields)
        parsed = F.from_csv(BROKEN_LINE, ddl, {**READ_OPTIONS, "header": "false"})
        # By way of JSON the row becomes a map of the fields that are not null.
        return F.from_json(F.to_json(parsed), "map<string,string>")

    texts = named(schema.fields, "string")
    values = named([f for f in schema.fields if f.name != BROKEN_LINE])
    numbers = [f.name for f in schema.fields if _is_number(f)]
    given = F.map_filter(
        texts, lambda name, text: name.isin(*numbers, BROKEN_LINE) & ~text.isin(*null_tokens))
    return F.array_except(F.map_keys(given), F.map_keys(values))


def _value(f: T.StructField, null_tokens: Sequence[str]) -> Column:
    """A column without its null texts."""
    c = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return F.when(~c.isin(*null_tokens), c)
    return F.nanvl(c, F.lit(None)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c


def typed(lines: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> CsvScan:
    """Take the null texts out of lines read by ``line_schema`` and set rows with faults apart.

    A value that cannot be read rejects its row, not the file. Spark's parser does the typing;
    only lines it marks as broken get a second look, which lets those through whose numbers are
    just null texts.
    """
    columns = [f for f in lines.schema.fields if f.name != BROKEN_LINE]

    # No row has fewer than 0 values: this drops nothing, but makes Spark read every column even
    # if the query wants few. A fault in a column that is not read would go unnoticed, and which
    # rows are good would depend on the columns asked for.
    read = lines.dropna(thresh=0)
    faults = _faults(lines.schema, null_tokens)
    broken = F.col(BROKEN_LINE).isNotNull()
    good = read.where(~broken | (F.size(faults) == 0))
    rejects = read.where(broken).withColumn(BAD_COLUMNS, faults).where(F.size(BAD_COLUMNS) > 0)
    return CsvScan(
        good.select(*[_value(f, null_tokens).cast(f.dataType).alias(f.name) for f in columns]),
        rejects.select(F.col(BROKEN_LINE).alias("line"), BAD_COLUMNS),
    )


def judged(lines: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """All lines read by ``line_schema``, in the types asked for. A line with a fault also has its text and the names
    of the columns at fault, both null in all others.

    The two parts of ``typed`` in one table, for loads that must account for every line.
    """
    columns = [f for f in lines.schema.fields if f.name != BROKEN_LINE]
    read = lines.dropna(thresh=0)
    faults = F.when(F.col(BROKEN_LINE).isNotNull(), _faults(lines.schema, null_tokens))
    # null if empty, with the faults written once: each mention would parse the line again
    read = read.withColumn(BAD_COLUMNS, F.get(F.filter(F.array(faults), lambda names: F.size(names) > 0), F.lit(0)))
    return read.select(
        *[_value(f, null_tokens).cast(f.dataType).alias(f.name) for f in columns],
        F.when(F.col(BAD_COLUMNS).isNotNull(), F.col(BROKEN_LINE)).alias(LINE), BAD_COLUMNS)


def flight_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = FLIGHT_SCHEMA) -> DataFrame:
    """Lines of CSV files that start with the same header line, typed by Spark's parser, broken ones marked."""
    return spark.read.options(**READ_OPTIONS).schema(line_schema(header_names(spark, path), schema)).csv(path)


def read_flights_csv(spark: SparkSession, path: str | Sequence[str],
                     schema: T.StructType = FLIGHT_SCHEMA,
                     null_tokens: Sequence[str] = NULL_TOKENS) -> CsvScan:
    """Scan CSV files that start with the same header line. Columns are found by name.

    Lines stay splittable: a field may not hold a line break.
    """
    return typed(flight_lines(spark, path, schema), null_tokens)


def read_sample_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of a drawn sample: the flight columns it has, its group and its month."""
    extra = [T.StructField("DELAY_GROUP", T.StringType()), T.StructField("SAMPLING_MONTH", T.IntegerType())]
    return read_flights_csv(spark, path, T.StructType([*FLIGHT_SCHEMA.fields, *extra])).good


def read_encoding(spark: SparkSession, path: str, col: str) -> DataFrame:
    """A target-encoding map kept as CSV: the category and its mean, in TE_<column>."""
    name = col.upper()
    schema = T.StructType([T.StructField(name, T.StringType()), T.StructField(f"TE_{name}", T.DoubleType())])
    means = read_flights_csv(spark, path, schema).good
    return means.select(F.col(name).alias(col), F.col(f"TE_{name}").alias(f"te_{col}")).dropna()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered CSV, one file per task."""
    df.write.mode(mode).options(**DIALECT).csv(path)
