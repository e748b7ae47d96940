"""File operators over the flights: each writes to the shared scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from airstats.binding import KEY, flights
from airstats.catalog.registry import query
from airstats.catalog.relational import _SAMPLE
from airstats.operators import features
from airstats.operators.filters import require, with_year_month
from airstats.plans.sampling import draw, with_strata
from airstats.schema import FLIGHT_SCHEMA
from airstats.sources import csv, parquet
from airstats.sources.drift import read_drifted
from airstats.storage import scratch_path
from airstats.streaming.ingest import FLIGHT_KEY, stream_ingest

_RAW = [f.name.lower() for f in FLIGHT_SCHEMA.fields]



_LOADED = """loaded AS (SELECT cast(substr(fl_date, 1, 4) AS int) AS year, month, arr_delay FROM flights
  WHERE origin IS NOT NULL AND dest IS NOT NULL)"""


def raw_csv(spark: SparkSession, sf: str, broken_numbers: bool = False) -> str:
    """Flights as raw CSV, the key as flight number; returns the folder."""
    df = flights(spark, sf)
    number = F.col(KEY).cast("string")
    if broken_numbers:
        number = F.when(F.col(KEY) % 10 == 7, F.concat(F.lit("F"), number)).otherwise(number)
    df = df.withColumn("op_carrier_fl_num", number)
    path = scratch_path(spark, "raw")
    csv.write_csv(df.select(*[F.col(c).alias(c.upper()) for c in _RAW if c in df.columns]), path)
    return path


def _all_years(spark: SparkSession, src: str) -> list[int]:
    rows = parquet.prepared(csv.read_flights_csv(spark, src).good)
    return [r.year for r in rows.select("year").distinct().collect()]


@query("s1_read_flights_csv", f"""SELECT flight_id, fl_date, op_carrier, origin, dest,
  nullif(dep_time, 'n/a') AS dep_time, cast(arr_delay AS float) AS arr_delay, month FROM flights
  WHERE flight_id % 10 <> 7""")
def read_flights_csv(spark: SparkSession, sf: str) -> DataFrame:
    good = csv.read_flights_csv(spark, raw_csv(spark, sf, broken_numbers=True)).good
    return good.select(
        F.col("op_carrier_fl_num").cast("bigint").alias(KEY),
        *[F.col(c).alias(c) for c in ("fl_date", "op_carrier", "origin", "dest", "dep_time", "arr_delay", "month")])


@query("s1_rejected_rows", """SELECT 'OP_CARRIER_FL_NUM' AS bad_column, count(*) AS n FROM flights
  WHERE flight_id % 10 = 7""")
def _(spark, sf):
    rejects = csv.read_flights_csv(spark, raw_csv(spark, sf, broken_numbers=True)).rejects
    return rejects.select(F.explode(csv.BAD_COLUMNS).alias("bad_column")).groupBy("bad_column").agg(
        F.count("*").alias("n"))


@query("s2_write_partitioned", """--- SELECT cast(substr(fl_date, 1, 4) AS int) AS year, month, count(*) AS n,
  cast(sum(flight_id) AS bigint) AS keys FROM flights GROUP BY 1, 2""")
def _(spark, sf):
    path = scratch_path(spark, "partitioned")
    parquet.write_partitioned(with_year_month(flights(spark, sf)), path)
    return spark.read.parquet(path).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.sum(KEY).alias("keys"))


@query("s3_load_years", _LOADED + """--- SELECT year, count(*) AS n,
  cast(sum(arr_delay) AS double) AS delay FROM loaded GROUP BY 1""")
def load_years(spark, sf):
    src, dst = raw_csv(spark, sf), scratch_path(spark, "years")
    years = _all_years(spark, src)
    parquet.load_years(spark, src, dst, years[:1])
    parquet.load_years(spark, src, dst, years)
    parquet.load_years(spark, src, dst, years)
    parquet.load_years(spark, src, dst, years[-1:], force=True)
    return spark.read.parquet(dst).groupBy("year").agg(
        F.count("*").alias("n"), F.sum(F.col("ARR_DELAY").cast("double")).alias("delay"))


@query("s4_stream_ingest", _LOADED + """--- SELECT year, month, count(*) AS n,
  cast(sum(arr_delay) AS double) AS delay FROM loaded GROUP BY 1, 2""")
def stream_load(spark, sf):
    src, dst, state = raw_csv(spark, sf), scratch_path(spark, "streamed"), scratch_path(spark, "progress")
    for _ in range(2):
        stream_ingest(spark, src, dst, state).awaitTermination()
    return spark.read.parquet(dst).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.sum(F.col("ARR_DELAY").cast("double")).alias("delay"))


# A number that cannot be read rejects its line, an end that is missing drops it.
_OUTCOMES = """outcomes AS (SELECT flight_id, cast(substr(fl_date, 1, 4) AS int) AS year, CASE WHEN flight_id % 10 = 7 THEN 'rejected'
  WHEN origin IS NULL OR dest IS NULL THEN 'dropped' ELSE 'loaded' END AS outcome FROM flights)"""


@query("s3_load_balance", _OUTCOMES + """--- SELECT 'all' AS years, outcome, count(*) AS n, CASE WHEN outcome <> 'loaded' THEN count(*) END AS held
  FROM outcomes GROUP BY 2 UNION ALL SELECT 'one', CASE WHEN outcome = 'loaded' AND year <> (SELECT min(year) FROM outcomes
    WHERE outcome = 'loaded') THEN 'other_year' ELSE outcome END AS what, count(*), CASE WHEN what IN ('rejected', 'dropped') THEN count(*) END
  FROM outcomes GROUP BY 2""")
def _(spark, sf):
    """What became of every line of a load of all years and of one, and the lines kept in quarantine."""
    src, out = raw_csv(spark, sf, broken_numbers=True), None
    years = sorted(_all_years(spark, src))
    for name, wanted in (("all", years), ("one", years[:1])):
        held = scratch_path(spark, "quarantine")
        done = parquet.load(spark, src, scratch_path(spark, "years"), wanted, quarantine=held)
        kept = spark.read.parquet(held).groupBy("outcome").agg(F.count("*").alias("held"))
        rows = spark.createDataFrame([(name, k, n) for k, n in done.counts.items() if k != "lines" and n],
                                     "years string, outcome string, n long").join(kept, "outcome", "left")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s4_stream_balance", _OUTCOMES + """--- SELECT outcome, 2 * count(*) AS lines,
  CASE WHEN outcome = 'loaded' THEN count(*) ELSE 2 * count(*) END AS kept FROM outcomes GROUP BY 1""")
def _(spark, sf):
    """All lines delivered twice, in files of other names: flights are loaded once, lines that are not loaded are all kept."""
    src, dst, state, held, book = (scratch_path(spark, n) for n in ("twice", "streamed", "progress", "quarantine", "loads"))
    raw = raw_csv(spark, sf, broken_numbers=True)
    lines = spark.read.text(raw).where("value not like 'FL_DATE,%'")
    header = ",".join(csv.header_names(spark, raw))
    for _ in range(2):
        lines.select(F.col("value").alias(header)).write.mode("append").option("header", True).option("quote", "").option(
            "escapeQuotes", False).option("sep", "\x01").csv(src)
        stream_ingest(spark, src, dst, state, quarantine=held, loads=book, key=FLIGHT_KEY).awaitTermination()
    counts = spark.read.parquet(book).select(F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in parquet.OUTCOMES[:3]]))).groupBy("outcome").agg(
        F.sum("n").alias("lines"))
    kept = spark.read.parquet(held).select("outcome").unionAll(spark.read.parquet(dst).select(F.lit("loaded").alias("outcome")))
    return counts.join(kept.groupBy("outcome").agg(F.count("*").alias("kept")), "outcome")


@query("s5_update_ledger", _LOADED + """--- SELECT string_agg(DISTINCT cast(year AS varchar), ',' ORDER BY
  cast(year AS varchar)) AS years, count(*) AS total_rows, count(DISTINCT year) AS sizes FROM loaded""")
def _(spark, sf):
    src, table, path = raw_csv(spark, sf), scratch_path(spark, "years"), scratch_path(spark, "ledger")
    parquet.load_years(spark, src, table, _all_years(spark, src))
    return parquet.update_ledger(spark, table, path).select(
        F.array_join(F.col("processed_years").cast("array<string>"), ",").alias("years"), "total_rows",
        F.size("file_sizes").cast("bigint").alias("sizes"))


@query("s5_merge_ledger", _LOADED + """--- SELECT string_agg(DISTINCT cast(year AS varchar), ',' ORDER BY
  cast(year AS varchar)) AS years, count(*) AS total_rows, count(DISTINCT year) AS sizes, true AS same FROM loaded""")
def _(spark, sf):
    """Years loaded one by one and one of them again, the ledger merged after each load; same as one counted in full."""
    table, path, book, whole = (scratch_path(spark, n) for n in ("years", "ledger", "book", "counted"))
    src = raw_csv(spark, sf)
    years = sorted(_all_years(spark, src))
    for wanted, force in [([y], False) for y in years] + [(years[:1], True)]:
        done = parquet.load(spark, src, table, wanted, force=force)
        merged = parquet.merge_ledger(spark, table, path, book, done.years)
    columns = ["processed_years", "total_rows", F.array_sort(F.map_entries("file_sizes")).alias("file_sizes")]
    counted = parquet.update_ledger(spark, table, whole).select(F.to_json(F.struct(*columns)).alias("row"))
    return merged.select(
        F.array_join(F.col("processed_years").cast("array<string>"), ",").alias("years"), "total_rows",
        F.size("file_sizes").cast("bigint").alias("sizes"),
        (F.to_json(F.struct(*columns)) == counted.scalar()).alias("same"))


@query("s6_partition_listing", """--- SELECT cast(substr(fl_date, 1, 4) AS int) AS year, count(*) AS rows,
  true AS has_files, true AS has_bytes FROM flights GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "partitioned")
    parquet.write_partitioned(with_year_month(flights(spark, sf)), path)
    return parquet.partition_listing(spark, path).select(
        "year", "rows", (F.col("files") >= 1).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


def _drifting(spark: SparkSession, sf: str) -> str:
    """Flights in two folders: with the month as number, and with the month as text."""
    df = flights(spark, sf).select(KEY, "op_carrier", "month")
    path = scratch_path(spark, "drift")
    df.where(F.col("op_carrier") < "C09").write.parquet(f"{path}/a")
    df.where(F.col("op_carrier") >= "C09").withColumn("month", F.col("month").cast("string")).write.parquet(f"{path}/b")
    return path


@query("s9_read_conforming", "SELECT flight_id, op_carrier, month FROM flights WHERE op_carrier < 'C09'")
def _(spark, sf):
    schema = flights(spark, sf).select(KEY, "op_carrier", "month").schema
    return parquet.read_conforming(spark, _drifting(spark, sf), schema)


@query("s9_read_drifted", """rows AS (SELECT flight_id, op_carrier, month, cast(substr(fl_date, 1, 4) AS int) AS year,
    origin, dest FROM flights WHERE fl_date IS NOT NULL AND month IS NOT NULL AND op_carrier IS NOT NULL)
  --- SELECT flight_id, op_carrier, month, year, CASE WHEN op_carrier >= 'C06' THEN coalesce(origin, '?') || '-' || coalesce(dest, '?') END AS ends,
  1 AS skipped FROM rows WHERE op_carrier < 'C09'""")
def _(spark, sf):
    """Four folders: year in path and file, a wider month under another name with a list of ends, months as text (left out)."""
    df = with_year_month(flights(spark, sf).where("fl_date IS NOT NULL AND month IS NOT NULL AND op_carrier IS NOT NULL"))
    df = df.select(KEY, "op_carrier", "month", "year", "origin", "dest")
    path, drop = scratch_path(spark, "drifted"), ["origin", "dest"]
    narrow = df.where("op_carrier < 'C03'").drop(*drop)
    for year in sorted(r.year for r in df.select("year").distinct().collect()):
        narrow.where(F.col("year") == year).write.parquet(f"{path}/a/year={year}")
    df.where("op_carrier >= 'C03' AND op_carrier < 'C06'").drop(*drop).write.partitionBy("year").parquet(f"{path}/b")
    wide = df.where("op_carrier >= 'C06' AND op_carrier < 'C09'").select(
        F.col(KEY).alias("Flight_Id"), "op_carrier", F.col("month").cast("bigint").alias("MON"), "year", F.array("origin", "dest").alias("ends"))
    wide.write.parquet(f"{path}/c")
    df.where("op_carrier >= 'C09'").withColumn("month", F.col("month").cast("string")).drop(*drop).coalesce(1).write.parquet(f"{path}/d")
    wanted = T.StructType([
        df.schema[KEY], df.schema["op_carrier"], T.StructField("month", T.LongType()), df.schema["year"],
        T.StructField("ends", T.ArrayType(T.StringType()))])
    got = read_drifted(spark, path, wanted, {"month": ["mon"]}, optional=["ends"])
    ends = F.array_join("ends", "-", "?")
    return got.rows.select(KEY, "op_carrier", F.col("month").cast("int").alias("month"), "year", ends.alias("ends"),
                           got.skipped.agg(F.count("*").cast("int")).scalar().alias("skipped"))


@query("a1b_type_profile", """--- SELECT * FROM (VALUES ('month', 'int32'), ('month', 'string'),
  ('op_carrier', 'string')) t("column", type)""")
def _(spark, sf):
    return parquet.type_profile(spark, _drifting(spark, sf), ["op_carrier", "month"]).select("column", "type")


@query("s10_read_sample_csv", _SAMPLE + """--- SELECT fl_date, op_carrier, origin, dest,
  cast(arr_delay AS float) AS arr_delay, cast(o_prcp AS float) AS o_prcp, month, delay_group,
  month AS sampling_month FROM sample""")
def _(spark, sf):
    drawn = draw(with_strata(flights(spark, sf)), KEY).withColumn("sampling_month", F.col("month")).drop("priority_score", KEY)
    path = scratch_path(spark, "sample")
    csv.write_csv(drawn.select(*[F.col(c).alias(c.upper()) for c in drawn.columns]), path)
    columns = ("fl_date", "op_carrier", "origin", "dest", "arr_delay", "o_prcp", "month", "delay_group",
               "sampling_month")
    return csv.read_sample_csv(spark, path).select(*[F.col(c).alias(c) for c in columns])


@query("s13_read_encoding", """base AS (SELECT dest, arr_delay + dep_delay AS total_delay FROM flights
    WHERE arr_delay IS NOT NULL AND dep_delay IS NOT NULL),
  te AS (SELECT dest, avg(total_delay) AS te FROM base WHERE dest IS NOT NULL GROUP BY 1)
  --- SELECT flight_id, round(coalesce(te, (SELECT avg(te) FROM te)), 6) AS te_dest
  FROM flights LEFT JOIN te ON te.dest = flights.dest""")
def _(spark, sf):
    df = flights(spark, sf)
    means = features.target_encoding(features.with_targets(require(df, ["arr_delay", "dep_delay"])), "dest", "total_delay")
    path = scratch_path(spark, "te-dest")
    csv.write_csv(means.select(F.col("dest").alias("DEST"), F.col("te_dest").alias("TE_DEST")), path)
    encoded = features.apply_encoding(df, csv.read_encoding(spark, path, "dest"), "dest")
    return encoded.select(KEY, F.round("te_dest", 6).alias("te_dest"))


@query("s11_write_csv", """ends AS (SELECT origin AS code, o_latitude AS lat, o_longitude AS lon FROM flights
    UNION ALL SELECT dest, d_latitude, d_longitude FROM flights)
  --- SELECT code, cast(count(*) AS varchar) AS total_flights FROM ends
  WHERE code IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from airstats.operators.airports import airport_statistics

    path = scratch_path(spark, "airports")
    csv.write_csv(airport_statistics(flights(spark, sf)), path)
    return spark.read.option("header", True).csv(path).select("code", "total_flights")
