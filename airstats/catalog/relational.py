"""Operators whose result is fixed by their input, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airstats import functions as fn
from airstats.binding import KEY, flights
from airstats.catalog.registry import query
from airstats.operators import (
    airports, compare, evaluate, features, filters, kpi, profile, rank, split, strata,
)
from airstats.plans import service
from airstats.plans.sampling import draw, draw_counted, frequent, with_strata
from airstats.storage import scratch_path
from airstats.streaming import requests

# SQL pieces used by several queries.

_HOUR = "cast(floor(trunc(coalesce(try_cast(dep_time AS double), 0)) / 100) AS int)"
_PEAK = f"({_HOUR} IN (6, 7, 8, 9, 16, 17, 18, 19))"
_GROUP = """CASE WHEN arr_delay > 60 AND arr_delay <= 99999 THEN 'Severe'
  WHEN arr_delay > 30 AND arr_delay <= 60 THEN 'Moderate'
  WHEN arr_delay > 0 AND arr_delay <= 30 THEN 'Minor'
  WHEN arr_delay > -999 AND arr_delay <= 0 THEN 'OnTime' END"""
_QUOTA = "CASE delay_group WHEN 'Severe' THEN 50 WHEN 'Moderate' THEN 100 WHEN 'Minor' THEN 150 ELSE 200 END"


def _level(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} <= 45 THEN 1 WHEN {x} <= 90 THEN 2 ELSE 3 END"


_SEASON = """CASE WHEN month IS NULL THEN 'Unknown' WHEN month IN (3, 4, 5) THEN 'Spring'
  WHEN month IN (6, 7, 8) THEN 'Summer' WHEN month IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END"""
_DEP_HOUR = "cast(coalesce(hour(try_cast(crs_dep_time AS timestamp)), 12) AS int)"
_WEEKEND = "CASE WHEN day_of_week >= 6 THEN 1 ELSE 0 END"

_TOPS = """
topc AS (SELECT op_carrier AS value, count(*) AS n FROM flights
  WHERE month IN (1, 7) AND op_carrier IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10),
topa AS (SELECT value, count(*) AS n FROM (
    SELECT origin AS value FROM flights WHERE month IN (1, 7)
    UNION ALL SELECT dest FROM flights WHERE month IN (1, 7)) WHERE value IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, value LIMIT 20)"""
_SCORED = _TOPS + f""",
scored AS (SELECT *, {_GROUP} AS delay_group, cast(1
  + CASE WHEN op_carrier IN (SELECT value FROM topc) THEN 2 ELSE 0 END
  + CASE WHEN origin IN (SELECT value FROM topa) OR dest IN (SELECT value FROM topa) THEN 1.5 ELSE 0 END
  + CASE WHEN {_PEAK} THEN 1 ELSE 0 END AS double) AS priority_score FROM flights)"""


def _hash(seed: str) -> str:
    return f"cast('0x' || substr(md5(concat({seed}, '|', flight_id)), 1, 13) AS bigint)"


def _hit(seed: str) -> str:
    return f"(-ln((cast({_hash(seed)} AS double) + 0.5) / 4503599627370496.0))"


def _race(scored: str, weight: str, out: str) -> str:
    hit = _hit("42 + month")
    return f"""
{out} AS (SELECT * EXCLUDE (w, hit, place) FROM (
  SELECT *, row_number() OVER (PARTITION BY month, delay_group
    ORDER BY CASE WHEN w > 0 THEN hit / w ELSE cast('inf' AS double) END, hit, flight_id) AS place
  FROM (SELECT *, cast({weight} AS double) AS w, {hit} AS hit FROM {scored}
        WHERE delay_group IS NOT NULL)) WHERE place <= {_QUOTA})"""


_SAMPLE = _SCORED + "," + _race("scored", "priority_score", "sample")

_FEATURES_BASE = f"""
base AS (SELECT *, arr_delay + dep_delay AS total_delay FROM flights
  WHERE arr_delay IS NOT NULL AND dep_delay IS NOT NULL)"""
_ROUTES = """
routes AS (SELECT origin, dest, avg(total_delay) AS route_mean FROM base
  WHERE origin IS NOT NULL AND dest IS NOT NULL GROUP BY 1, 2)"""
_TOP_ENDS = """
topo AS (SELECT coalesce(origin, 'nan') AS value FROM base GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
topd AS (SELECT coalesce(dest, 'nan') AS value FROM base GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)"""


# DataFrames used by several queries.

def sampled(df: DataFrame) -> DataFrame:
    return draw(df, KEY)


def _with_total(df: DataFrame) -> DataFrame:
    return features.with_targets(filters.require(df, ["arr_delay", "dep_delay"]))


def _predicted(df: DataFrame) -> DataFrame:
    """Flights with their level and one guessed from the arrival delay alone."""
    return _with_total(df).select(
        KEY, F.col("delay_level").alias("label"), F.col("total_delay"),
        fn.delay_level(F.col("arr_delay") * 1.5).alias("prediction"),
        (F.col("arr_delay") * 1.5).alias("minutes"),
    )


_PREDICTED = _FEATURES_BASE + f""",
pred AS (SELECT flight_id, {_level('total_delay')} AS label, total_delay,
  {_level('(arr_delay * 1.5)')} AS prediction, arr_delay * 1.5 AS minutes FROM base)"""


# Scans, filters, projections.

@query("s7_scan_months", "SELECT op_carrier, origin, dest FROM flights WHERE month IN (1, 7)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filters.scan_months(flights(spark, sf), rank.SURVEYED_MONTHS, ["op_carrier", "origin", "dest"])


@query("p1_require", """SELECT flight_id, origin, dest, op_carrier, fl_date FROM flights
  WHERE origin IS NOT NULL AND dest IS NOT NULL AND op_carrier IS NOT NULL AND fl_date IS NOT NULL""")
def _(spark, sf):
    return filters.require(flights(spark, sf)).select("flight_id", "origin", "dest", "op_carrier", "fl_date")


@query("p2_year_month", """SELECT flight_id, cast(substr(fl_date, 1, 4) AS int) AS year,
  cast(split_part(fl_date, '-', 2) AS int) AS month FROM flights""")
def _(spark, sf):
    return filters.with_year_month(flights(spark, sf)).select("flight_id", "year", "month")


@query("p3_for_year", """SELECT flight_id, cast(substr(fl_date, 1, 4) AS int) AS year,
  cast(split_part(fl_date, '-', 2) AS int) AS month FROM flights WHERE substr(fl_date, 1, 4) = '1997'""")
def _(spark, sf):
    dated = filters.with_year_month(flights(spark, sf))
    return filters.for_year(dated, 1997).select("flight_id", "year", "month")


_CLEAN_COLUMNS = """flight_id, crs_dep_time, crs_elapsed_time, op_carrier, origin, dest, month, day_of_week,
  coalesce(o_prcp, 0) AS o_prcp, coalesce(o_wspd, 0) AS o_wspd,
  coalesce(d_prcp, 0) AS d_prcp, coalesce(d_wspd, 0) AS d_wspd"""


@query("p5_clean_for_model", f"""SELECT {_CLEAN_COLUMNS}, arr_delay, dep_delay FROM flights
  WHERE arr_delay IS NOT NULL AND dep_delay IS NOT NULL""")
def _(spark, sf):
    return filters.clean_for_model(flights(spark, sf), keep=[KEY])


@query("p5_clean_null_delay_as_zero", f"""SELECT {_CLEAN_COLUMNS}, coalesce(arr_delay, 0) AS arr_delay,
  coalesce(dep_delay, 0) AS dep_delay FROM flights""")
def _(spark, sf):
    return filters.clean_for_model(flights(spark, sf), "zero", keep=[KEY])


@query("p6_delay_group", f"SELECT flight_id, {_GROUP} AS delay_group FROM flights WHERE {_GROUP} IS NOT NULL")
def _(spark, sf):
    df = flights(spark, sf).select(KEY, fn.delay_group("arr_delay").alias("delay_group"))
    return df.where("delay_group IS NOT NULL")


@query("p7_delay_level", f"""SELECT flight_id, {_level('(coalesce(arr_delay, 0) + coalesce(dep_delay, 0))')}
  AS delay_level FROM flights""")
def _(spark, sf):
    return features.with_targets(flights(spark, sf)).select(KEY, "delay_level")


@query("p9_is_peak", f"SELECT flight_id, {_PEAK} AS peak FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.is_peak(fn.hhmm_hour("dep_time")).alias("peak"))


@query("p11_in_box", """ends AS (
    SELECT origin AS code, o_latitude AS lat, o_longitude AS lon FROM flights
    UNION ALL SELECT dest, d_latitude, d_longitude FROM flights),
  stats AS (SELECT code, min(lat) AS lat, min(lon) AS lon, count(*) AS total_flights FROM ends
    WHERE code IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1)
  --- SELECT code, lat, lon, total_flights, 'map' AS map FROM stats
      WHERE lon BETWEEN -130 AND -65 AND lat BETWEEN 20 AND 55
  UNION ALL SELECT code, lat, lon, total_flights, 'small map' FROM stats
      WHERE lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50""")
def _(spark, sf):
    stats = airports.airport_counts(flights(spark, sf))
    return filters.in_box(stats).withColumn("map", F.lit("map")).unionByName(
        filters.in_box(stats, filters.SMALL_MAP_BOX).withColumn("map", F.lit("small map")))


@query("p13_missing_codes", """SELECT cast(r.range AS int) AS code FROM range(1, 61) r
  WHERE r.range NOT IN (SELECT cast(d_wspd AS bigint) FROM flights WHERE d_wspd IS NOT NULL)""")
def _(spark, sf):
    return filters.missing_codes(flights(spark, sf), "d_wspd", 1, 60)


# Scalar functions.

@query("c2_to_number", """SELECT flight_id, coalesce(try_cast(dep_time AS double), 0) AS number,
  try_cast(crs_dep_time AS double) AS text_number FROM flights""")
def _(spark, sf):
    return flights(spark, sf).select(
        KEY, fn.to_number("dep_time").alias("number"), fn.to_number("crs_dep_time", None).alias("text_number"))


@query("c3_hhmm_hour", f"SELECT flight_id, {_HOUR} AS hour FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.hhmm_hour("dep_time").alias("hour"))


@query("c4_datetime_hour", f"SELECT flight_id, {_DEP_HOUR} AS hour FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.datetime_hour("crs_dep_time").alias("hour"))


@query("c5_iso_weekday", "SELECT flight_id, cast(isodow(cast(fl_date AS date)) AS int) AS day FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.iso_weekday("fl_date").alias("day"))


@query("c6_calendar_month", "SELECT flight_id, cast(month(cast(fl_date AS date)) AS int) AS month FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.calendar_month("fl_date").alias("month"))


@query("c7_is_weekend", f"SELECT flight_id, {_WEEKEND} AS weekend FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.is_weekend("day_of_week").alias("weekend"))


@query("c8_season", f"SELECT flight_id, {_SEASON} AS season FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.season("month").alias("season"))


@query("c9_time_of_day", f"""SELECT flight_id, CASE WHEN {_HOUR} < 6 THEN 0 WHEN {_HOUR} < 12 THEN 1
  WHEN {_HOUR} < 18 THEN 2 ELSE 3 END AS bucket FROM flights""")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.time_of_day(fn.hhmm_hour("dep_time")).alias("bucket"))


@query("c11_marker_size", """ends AS (
    SELECT origin AS code, o_latitude AS lat, o_longitude AS lon FROM flights
    UNION ALL SELECT dest, d_latitude, d_longitude FROM flights)
  --- SELECT code, round(sqrt(count(*)) * 8, 6) AS size, round(sqrt(count(*)) * 3, 6) AS small_size
  FROM ends WHERE code IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    stats = airports.airport_counts(flights(spark, sf))
    return stats.select(
        "code", F.round(fn.marker_size("total_flights"), 6).alias("size"),
        F.round(fn.marker_size("total_flights", 3.0), 6).alias("small_size"))


@query("c13_argmax", """SELECT flight_id, cast(list_position(v, list_max(v)) - 1 AS int) AS place FROM (
  SELECT flight_id, [o_wspd, d_wspd, o_temp, d_temp] AS v FROM flights WHERE o_wspd IS NOT NULL)""")
def _(spark, sf):
    df = flights(spark, sf).where("o_wspd IS NOT NULL")
    return df.select(KEY, fn.argmax(F.array("o_wspd", "d_wspd", "o_temp", "d_temp")).alias("place"))


@query("c14_first_token", "SELECT flight_id, split_part(crs_dep_time, ' ', 1) AS token FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.first_token("crs_dep_time").alias("token"))


@query("c15_code_text", "SELECT flight_id, coalesce(dest, 'nan') AS dest FROM flights")
def _(spark, sf):
    return flights(spark, sf).select(KEY, fn.code_text("dest").alias("dest"))


# Aggregations, rankings.

@query("a1_value_profile", """pairs AS (
    SELECT 'op_carrier' AS "column", op_carrier AS value FROM flights
    UNION ALL SELECT 'origin', origin FROM flights
    UNION ALL SELECT 'dest', dest FROM flights
    UNION ALL SELECT 'month', cast(month AS varchar) FROM flights
    UNION ALL SELECT 'fl_date', fl_date FROM flights),
  counts AS (SELECT "column", value, count(*) AS n FROM pairs GROUP BY 1, 2),
  totals AS (SELECT "column", sum(n) AS all_rows, count(value) AS cardinality FROM counts GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
    FROM counts WHERE value IS NOT NULL)
  --- SELECT r."column", cast(rank AS int) AS rank, value, n, round(n * 100.0 / all_rows, 2) AS percent,
    cardinality FROM ranked r JOIN totals t ON t."column" = r."column" WHERE rank <= 15""")
def _(spark, sf):
    return profile.value_profile(flights(spark, sf), ["op_carrier", "origin", "dest", "month", "fl_date"])


_ENDS_SQL = """ends AS (
    SELECT origin AS code, o_latitude AS lat, o_longitude AS lon FROM flights
    UNION ALL SELECT dest, d_latitude, d_longitude FROM flights),
  stats AS (SELECT code, min(lat) AS lat, min(lon) AS lon, count(*) AS total_flights FROM ends
    WHERE code IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1)"""


@query("a2_airport_statistics", _ENDS_SQL + "--- SELECT code, lat, lon, total_flights FROM stats")
def airport_statistics(spark, sf):
    return airports.airport_statistics(flights(spark, sf))


@query("a3_count_summary", _ENDS_SQL + """--- SELECT cast(sum(total_flights) AS bigint) AS total,
    cast(sum(total_flights) AS double) / count(*) AS mean, median(total_flights) AS median,
    max(total_flights) AS max,
    (SELECT code FROM stats ORDER BY total_flights DESC, code LIMIT 1) AS max_code,
    min(total_flights) AS min FROM stats""")
def _(spark, sf):
    return airports.count_summary(airports.airport_counts(flights(spark, sf)))


@query("a4_count_bins", _ENDS_SQL + """, bins(bin, label, low, high) AS (VALUES
    (1, 'Rất ít (0-10)', 0, 10), (2, 'Ít (11-50)', 10, 50), (3, 'Trung bình (51-100)', 50, 100),
    (4, 'Nhiều (101-200)', 100, 200), (5, 'Rất nhiều (201-500)', 200, 500),
    (6, 'Cực nhiều (500+)', 500, 1000)),
  per_route AS (SELECT concat(origin, '>', dest) AS code, count(*) AS total_flights FROM flights
    WHERE origin IS NOT NULL AND dest IS NOT NULL GROUP BY 1),
  entities AS (SELECT 'airport' AS entity, total_flights FROM stats
    UNION ALL SELECT 'route', total_flights FROM per_route),
  sizes AS (SELECT entity, count(*) AS n FROM entities GROUP BY 1)
  --- SELECT s.entity, bin, label, count(e.total_flights) AS airports,
    count(e.total_flights) * 100.0 / any_value(s.n) AS percent
  FROM sizes s CROSS JOIN bins LEFT JOIN entities e
    ON e.entity = s.entity AND e.total_flights > low AND e.total_flights <= high GROUP BY 1, 2, 3""")
def _(spark, sf):
    df = flights(spark, sf)
    per_route = (
        filters.require(df, ["origin", "dest"]).groupBy("origin", "dest")
        .agg(F.count("*").alias("total_flights")))
    return (
        airports.count_bins(airports.airport_counts(df)).withColumn("entity", F.lit("airport"))
        .unionByName(airports.count_bins(per_route).withColumn("entity", F.lit("route"))))


@query("a5_top_carriers", _TOPS + "--- SELECT value, n FROM topc")
def _(spark, sf):
    return rank.top_values(flights(spark, sf), ["op_carrier"], rank.TOP_CARRIERS, rank.SURVEYED_MONTHS)


@query("a5_top_airports", _TOPS + "--- SELECT value, n FROM topa")
def _(spark, sf):
    return rank.top_values(flights(spark, sf), ["origin", "dest"], rank.TOP_AIRPORTS, rank.SURVEYED_MONTHS)


@query("a6_priority_score", _SCORED + "--- SELECT flight_id, priority_score FROM scored")
def _(spark, sf):
    return with_strata(flights(spark, sf)).select(KEY, "priority_score")


@query("a7_stratified_sample", _SAMPLE + "--- SELECT flight_id, month, delay_group, priority_score FROM sample")
def stratified_sample(spark, sf):
    return sampled(with_strata(flights(spark, sf)).select(KEY, "month", "delay_group", "priority_score"))


@query("a7b_sample_without_weights", _SCORED + "," + _race(
    "scored", "CASE WHEN delay_group = 'OnTime' OR op_carrier = 'C03' THEN 0 ELSE priority_score END",
    "sample") + "--- SELECT flight_id, month, delay_group FROM sample")
def _(spark, sf):
    weight = F.when((F.col("delay_group") == "OnTime") | (F.col("op_carrier") == "C03"), 0.0).otherwise(
        F.col("priority_score"))
    df = with_strata(flights(spark, sf)).withColumn("priority_score", weight)
    drawn = sampled(df.select(KEY, "month", "delay_group", "priority_score"))
    return drawn.drop("priority_score")


@query("a8_sampling_log", _SAMPLE + """,
  groups(delay_group) AS (VALUES ('Severe'), ('Moderate'), ('Minor'), ('OnTime')),
  months AS (SELECT DISTINCT month FROM flights WHERE month IS NOT NULL),
  a AS (SELECT month, delay_group, count(*) AS n FROM scored GROUP BY 1, 2),
  s AS (SELECT month, delay_group, count(*) AS n FROM sample GROUP BY 1, 2)
  --- SELECT m.month, g.delay_group, coalesce(a.n, 0) AS available, coalesce(s.n, 0) AS sampled
  FROM months m CROSS JOIN groups g
  LEFT JOIN a ON a.month = m.month AND a.delay_group = g.delay_group
  LEFT JOIN s ON s.month = m.month AND s.delay_group = g.delay_group""")
def _(spark, sf):
    drawn = draw_counted(with_strata(flights(spark, sf)), KEY)
    return strata.sampling_log(drawn.available, drawn.rows)


@query("a8_group_shares", _SAMPLE + """--- SELECT delay_group, count(*) AS n,
  cast(count(*) AS double) / (SELECT count(*) FROM sample) AS share FROM sample GROUP BY 1""")
def _(spark, sf):
    return strata.group_shares(sampled(with_strata(flights(spark, sf))))


@query("a8_carrier_coverage", _SAMPLE + """--- SELECT
  avg(CASE WHEN op_carrier IN (SELECT value FROM topc) THEN 1 ELSE 0 END) AS coverage FROM sample""")
def _(spark, sf):
    df = flights(spark, sf)
    top = frequent(df)
    return strata.carrier_coverage(sampled(with_strata(df, top=top)), top[0])


def _share(table: str, col: str, out: str) -> str:
    return f"""{out} AS (SELECT {col}, cast(count(*) AS double) / (SELECT count({col}) FROM {table}) AS share
  FROM {table} WHERE {col} IS NOT NULL GROUP BY 1)"""


@query("a9_share_compare", _SAMPLE + "," + _share("flights", "op_carrier", "p") + ","
       + _share("sample", "op_carrier", "s") + """--- SELECT p.op_carrier, p.share AS share_pop,
  s.share AS share_sample, abs(p.share - s.share) AS diff FROM p JOIN s ON s.op_carrier = p.op_carrier
  ORDER BY p.share DESC, p.op_carrier LIMIT 5""")
def share_compare(spark, sf):
    df = flights(spark, sf)
    return compare.share_compare(df, sampled(with_strata(df)), "op_carrier")


@query("a9_share_compare_full", _SAMPLE + "," + _share("flights", "fl_date", "p") + ","
       + _share("sample", "fl_date", "s") + """--- SELECT p.fl_date, p.share AS share_pop,
  coalesce(s.share, 0) AS share_sample, abs(p.share - coalesce(s.share, 0)) AS diff
  FROM p LEFT JOIN s ON s.fl_date = p.fl_date""")
def _(spark, sf):
    df = flights(spark, sf)
    return compare.share_compare(df, sampled(with_strata(df)), "fl_date", how="full", top=None)


@query("a9_share_chart", _SAMPLE + "," + _share("flights", "op_carrier", "p") + ","
       + _share("sample", "op_carrier", "s") + """--- SELECT op_carrier, share, 'Population' AS type FROM p
  UNION ALL SELECT op_carrier, share, 'Sample' FROM s""")
def _(spark, sf):
    df = flights(spark, sf)
    return compare.share_chart(df, sampled(with_strata(df)), "op_carrier")


@query("a10_topk_share_compare", _SAMPLE + """,
  t AS (SELECT origin FROM flights WHERE origin IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
  pt AS (SELECT origin FROM flights WHERE origin IN (SELECT origin FROM t)),
  st AS (SELECT origin FROM sample WHERE origin IN (SELECT origin FROM t)),""" + _share("pt", "origin", "p")
       + "," + _share("st", "origin", "s") + """--- SELECT origin, share, 'Population' AS type FROM p
  UNION ALL SELECT origin, share, 'Sample' FROM s""")
def _(spark, sf):
    df = flights(spark, sf)
    return compare.topk_share_compare(df, sampled(with_strata(df)))


@query("a11_hour_distribution", _SAMPLE + f""",
  ph AS (SELECT {_HOUR} AS hour FROM flights), sh AS (SELECT {_HOUR} AS hour FROM sample),"""
       + _share("ph", "hour", "p") + "," + _share("sh", "hour", "s")
       + """--- SELECT hour, share, 'Population' AS type FROM p UNION ALL SELECT hour, share, 'Sample' FROM s""")
def _(spark, sf):
    df = flights(spark, sf)
    return compare.hour_distribution(df, sampled(with_strata(df)))


@query("a12_peak_compare", _SAMPLE + f""", r AS (
  SELECT (SELECT avg(cast({_PEAK} AS int)) FROM flights) AS peak_pop,
         (SELECT avg(cast({_PEAK} AS int)) FROM sample) AS peak_sample)
  --- SELECT peak_pop, peak_sample, abs(peak_pop - peak_sample) AS diff FROM r""")
def _(spark, sf):
    df = flights(spark, sf)
    return compare.peak_compare(df, sampled(with_strata(df)))


@query("a13_temporal_coverage", """SELECT 'month' AS part, cast(r.range AS int) AS code FROM range(1, 13) r
    WHERE r.range NOT IN (SELECT month FROM flights WHERE month IS NOT NULL)
  UNION ALL SELECT 'day', cast(r.range AS int) FROM range(1, 8) r
    WHERE r.range NOT IN (SELECT day_of_week FROM flights WHERE day_of_week IS NOT NULL)""")
def _(spark, sf):
    return filters.temporal_coverage(flights(spark, sf))


@query("a14_load_totals", """SELECT count(*) AS total_rows, count(DISTINCT substr(fl_date, 1, 4)) AS years,
  count(DISTINCT substr(fl_date, 1, 7)) AS months FROM flights""")
def _(spark, sf):
    return kpi.load_totals(filters.with_year_month(flights(spark, sf)))


@query("a15_kpis", _ENDS_SQL + """--- SELECT (SELECT count(*) FROM flights) AS total_flights,
  (SELECT avg(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END) FROM flights WHERE arr_delay IS NOT NULL) AS late_share,
  (SELECT op_carrier FROM flights WHERE arr_delay IS NOT NULL AND op_carrier IS NOT NULL GROUP BY 1
    ORDER BY avg(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END) DESC, 1 LIMIT 1) AS worst_carrier,
  (SELECT code FROM stats ORDER BY total_flights DESC, code LIMIT 1) AS busiest_airport,
  (SELECT count(*) FROM stats) AS airports,
  (SELECT avg(t) FROM (SELECT o_temp AS t FROM flights UNION ALL SELECT d_temp FROM flights)) AS mean_temp""")
def kpis(spark, sf):
    return kpi.kpis(flights(spark, sf))


@query("a16_monthly_trend", """SELECT month, count(*) AS flights, avg(arr_delay) AS mean_delay,
  avg(CASE WHEN arr_delay IS NULL THEN NULL WHEN arr_delay > 15 THEN 1 ELSE 0 END) AS late_share
  FROM flights GROUP BY 1""")
def _(spark, sf):
    return kpi.monthly_trend(flights(spark, sf))


@query("a17_route_ranking", _FEATURES_BASE + """--- SELECT origin, dest, avg(total_delay) AS route_risk,
  count(*) AS flights FROM base WHERE origin IS NOT NULL AND dest IS NOT NULL GROUP BY 1, 2
  HAVING count(*) >= 10""")
def route_ranking(spark, sf):
    return rank.route_ranking(_with_total(flights(spark, sf)), 10)


# Features.

@query("f1_total_delay", """SELECT flight_id, coalesce(arr_delay, 0) + coalesce(dep_delay, 0) AS total_delay
  FROM flights""")
def _(spark, sf):
    return features.with_targets(flights(spark, sf)).select(KEY, "total_delay")


@query("f3_time_features", f"""SELECT flight_id, {_DEP_HOUR} AS dep_hour, {_WEEKEND} AS is_weekend,
  {_SEASON} AS season FROM flights""")
def _(spark, sf):
    return features.with_time_features(flights(spark, sf)).select(KEY, "dep_hour", "is_weekend", "season")


@query("f6_route_risk", _FEATURES_BASE + "," + _ROUTES + """--- SELECT flight_id,
  coalesce(route_mean, (SELECT avg(total_delay) FROM base)) AS route_risk
  FROM base LEFT JOIN routes ON routes.origin = base.origin AND routes.dest = base.dest""")
def _(spark, sf):
    return features.route_risk(_with_total(flights(spark, sf)), "all").select(KEY, "route_risk")


@query("f6_route_risk_train_only", _FEATURES_BASE + f""",
  marked AS (SELECT *, (cast({_hash('42')} AS double) + 0.5) / 4503599627370496.0 < 0.2 AS test FROM base),
  tr AS (SELECT origin, dest, avg(total_delay) AS route_mean FROM marked
    WHERE NOT test AND origin IS NOT NULL AND dest IS NOT NULL GROUP BY 1, 2)
  --- SELECT flight_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split,
  coalesce(route_mean, (SELECT avg(total_delay) FROM marked WHERE NOT test)) AS route_risk
  FROM marked LEFT JOIN tr ON tr.origin = marked.origin AND tr.dest = marked.dest""")
def _(spark, sf):
    df = split.stratified_split(_with_total(flights(spark, sf)), "delay_level", KEY, exact=False)
    return features.route_risk(df, "train", "split").select(KEY, "split", "route_risk")


def _folds(by: list[str], learnt: str = "true") -> str:
    """Sums of total_delay per fold, of categories and of all, and each row's mean of the others, as CTEs."""
    same = " AND ".join(f"o.{c} = r.{c}" for c in by)
    return f""",
  r AS (SELECT *, {learnt} AS learnt, {_hash(str(features.FOLD_SEED))} % {features.FOLDS} AS fold FROM base),
  o AS (SELECT {', '.join(by)}, fold, sum(total_delay) AS s, count(*) AS k FROM r WHERE learnt GROUP BY ALL),
  own AS (SELECT flight_id, sum(o.s) / sum(o.k) AS mean FROM r JOIN o ON {same} AND (o.fold <> r.fold OR NOT r.learnt)
    GROUP BY 1),
  every AS (SELECT f.fold, sum(o.s) / sum(o.k) AS mean, (SELECT sum(s) / sum(k) FROM o) AS whole
    FROM (SELECT DISTINCT fold FROM r) f JOIN o ON o.fold <> f.fold GROUP BY 1)"""


@query("f6_route_risk_out_of_fold", _FEATURES_BASE + _folds(["origin", "dest"]) + """--- SELECT flight_id,
  round(coalesce(own.mean, every.mean), 6) AS route_risk FROM r LEFT JOIN own USING (flight_id) JOIN every USING (fold)""")
def _(spark, sf):
    df, by = _with_total(flights(spark, sf)), ["origin", "dest"]
    sums = features.out_of_fold_sums(df, by, "total_delay", KEY)
    found = features.with_out_of_fold_mean(df, sums, by, "route_risk", KEY)
    return found.select(KEY, F.round("route_risk", 6).alias("route_risk"))


@query("f12_out_of_fold_encoding", _FEATURES_BASE + _folds(
    ["dest"], f"(cast({_hash('42')} AS double) + 0.5) / 4503599627370496.0 >= 0.2") + """--- SELECT flight_id, learnt,
  round(coalesce(own.mean, CASE WHEN learnt THEN every.mean ELSE every.whole END), 6) AS te_dest
  FROM r LEFT JOIN own USING (flight_id) JOIN every USING (fold)""")
def _(spark, sf):
    """Training rows take the mean of the other folds, test rows that of all training rows."""
    df = split.stratified_split(_with_total(flights(spark, sf)), "delay_level", KEY, exact=False)
    learnt = F.col("split") == features.TRAIN
    sums = features.out_of_fold_sums(df.where(learnt), ["dest"], "total_delay", KEY)
    found = features.with_out_of_fold_mean(df, sums, ["dest"], "te_dest", KEY, learnt=learnt)
    return found.select(KEY, learnt.alias("learnt"), F.round("te_dest", 6).alias("te_dest"))


@query("f7_group_other", """
  topo AS (SELECT coalesce(origin, 'nan') AS value FROM flights GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
  topd AS (SELECT coalesce(dest, 'nan') AS value FROM flights GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
  --- SELECT flight_id,
  CASE WHEN coalesce(origin, 'nan') IN (SELECT value FROM topo) THEN coalesce(origin, 'nan') ELSE 'OTHER' END AS origin_grouped,
  CASE WHEN coalesce(dest, 'nan') IN (SELECT value FROM topd) THEN coalesce(dest, 'nan') ELSE 'OTHER' END AS dest_grouped
  FROM flights""")
def _(spark, sf):
    df = rank.group_other(rank.group_other(flights(spark, sf), "origin"), "dest")
    return df.select(KEY, "origin_grouped", "dest_grouped")


def _z(c: str) -> str:
    return f"""round(({c} - (SELECT avg({c}) FROM base)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1
      ELSE stddev_pop({c}) END FROM base), 6) AS {c}"""


@query("f8_standardise", _FEATURES_BASE + f"""--- SELECT flight_id, {_z('crs_elapsed_time')}, {_z('total_delay')},
  {_z('o_prcp')}, {_z('o_wspd')}, {_z('d_prcp')}, {_z('d_wspd')} FROM base""")
def _(spark, sf):
    cols = ["crs_elapsed_time", "total_delay", "o_prcp", "o_wspd", "d_prcp", "d_wspd"]
    df = features.standardise(_with_total(flights(spark, sf)), cols)
    return df.select(KEY, *[F.round(c, 6).alias(c) for c in cols])


_FEATURES_SQL = _FEATURES_BASE + "," + _ROUTES + "," + _TOP_ENDS + f""",
features AS (SELECT flight_id, crs_elapsed_time, op_carrier, month, day_of_week,
  coalesce(o_prcp, 0) AS o_prcp, coalesce(o_wspd, 0) AS o_wspd,
  coalesce(d_prcp, 0) AS d_prcp, coalesce(d_wspd, 0) AS d_wspd,
  total_delay, {_level('total_delay')} AS delay_level,
  {_DEP_HOUR} AS dep_hour, {_WEEKEND} AS is_weekend, {_SEASON} AS season,
  coalesce(route_mean, (SELECT avg(total_delay) FROM base)) AS route_risk,
  CASE WHEN coalesce(base.origin, 'nan') IN (SELECT value FROM topo) THEN coalesce(base.origin, 'nan') ELSE 'OTHER' END AS origin_grouped,
  CASE WHEN coalesce(base.dest, 'nan') IN (SELECT value FROM topd) THEN coalesce(base.dest, 'nan') ELSE 'OTHER' END AS dest_grouped
  FROM base LEFT JOIN routes ON routes.origin = base.origin AND routes.dest = base.dest)"""


@query("f10_build_features", _FEATURES_SQL + "--- SELECT * FROM features")
def build_features(spark, sf):
    return features.build_features(flights(spark, sf), [KEY], fit_on="all")


_ENCODING_SQL = _FEATURES_BASE + ", " + ", ".join(
    f"te_{c} AS (SELECT {c}, avg(total_delay) AS te FROM base WHERE {c} IS NOT NULL GROUP BY 1)"
    for c in features.ENCODED_COLUMNS)


@query("f12_target_encoding", _ENCODING_SQL + """--- SELECT f.flight_id,
  round(coalesce(te, (SELECT avg(te) FROM te_dest)), 6) AS te_dest
  FROM flights f LEFT JOIN te_dest ON te_dest.dest = f.dest""")
def _(spark, sf):
    df = flights(spark, sf)
    mapping = features.target_encoding(_with_total(df), "dest", "total_delay")
    encoded = features.apply_encoding(df, mapping, "dest")
    return encoded.select(KEY, F.round("te_dest", 6).alias("te_dest"))


_COUNTS = """
counts AS (SELECT origin, dest, count(*) AS n FROM flights
  WHERE origin IS NOT NULL AND dest IS NOT NULL GROUP BY 1, 2)"""


@query("f13_route_count", _COUNTS + """--- SELECT f.flight_id, coalesce(n, 0) AS route_count
  FROM flights f LEFT JOIN counts c ON c.origin = f.origin AND c.dest = f.dest""")
def _(spark, sf):
    return features.route_count(flights(spark, sf)).select(KEY, "route_count")


def _te(c: str) -> str:
    return f"round(cast(coalesce({c}.te, (SELECT avg(te) FROM {c})) AS float), 3) AS {c.upper()}"


_SERVING_SQL = (_ENCODING_SQL + "," + _COUNTS + f"""--- SELECT f.flight_id,
  cast(month AS float) AS "MONTH", cast(day_of_week AS float) AS "DAY_OF_WEEK",
  cast({_DEP_HOUR} AS float) AS "HOUR",
  cast(CASE WHEN {_DEP_HOUR} < 6 THEN 0 WHEN {_DEP_HOUR} < 12 THEN 1 WHEN {_DEP_HOUR} < 18 THEN 2 ELSE 3 END
    AS float) AS "TIME_OF_DAY",
  cast(coalesce(n, 0) AS float) AS "ROUTE_COUNT", cast(crs_elapsed_time AS float) AS "CRS_ELAPSED_TIME",
  {_te('te_op_carrier')}, {_te('te_origin')}, {_te('te_dest')}
  FROM flights f LEFT JOIN counts c ON c.origin = f.origin AND c.dest = f.dest
  LEFT JOIN te_op_carrier ON te_op_carrier.op_carrier = f.op_carrier
  LEFT JOIN te_origin ON te_origin.origin = f.origin LEFT JOIN te_dest ON te_dest.dest = f.dest""")


@query("f14_serving_features", _SERVING_SQL)
def serving_features(spark, sf):
    df = flights(spark, sf)
    rows = features.serving_features(service.requests(df), service.encodings(_with_total(df)), [KEY])
    return rows.withColumns({
        c: F.round(c, 3) for c in features.SERVING_FEATURES if c.startswith("TE_")})


@query("m16_stream_requests", _SERVING_SQL)
def stream_requests(spark, sf):
    """Requests that arrive as a stream, encoded by the newest maps: codes without flights of known delay are unseen."""
    df = flights(spark, sf)
    maps, src, dst, state = (scratch_path(spark, n) for n in ("maps", "arrivals", "encoded", "progress"))
    # an older version, learnt from few months, must not be used
    for learnt in (df.where("month < 3"), df):
        requests.save_maps(service.encodings(_with_total(learnt)), features.route_flights(learnt), maps)
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    requests.write_requests(stream, maps, dst, state, [KEY]).awaitTermination()
    rows = spark.read.parquet(dst).drop("batch")
    return rows.withColumns({c: F.round(c, 3) for c in features.SERVING_FEATURES if c.startswith("TE_")})


# Splits, weights, reports.

@query("m1_stratified_split", _FEATURES_BASE + f""",
  d AS (SELECT flight_id, {_level('total_delay')} AS delay_level, {_hash('42')} AS h FROM base),
  c AS (SELECT delay_level, cast(count(*) AS hugeint) AS n FROM d GROUP BY 1),
  w AS (SELECT *, cast(ceil(0.2 * (SELECT count(*) FROM d)) AS hugeint) AS wanted,
        (SELECT cast(count(*) AS hugeint) FROM d) AS total FROM c),
  b AS (SELECT *, (n * wanted) // total AS base, (n * wanted) % total AS rest FROM w),
  q AS (SELECT delay_level, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, delay_level)
        <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
  r AS (SELECT d.flight_id, d.delay_level, quota,
        row_number() OVER (PARTITION BY d.delay_level ORDER BY h, cast(flight_id AS varchar)) AS place
        FROM d JOIN q ON q.delay_level = d.delay_level)
  --- SELECT flight_id, delay_level, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    df = _with_total(flights(spark, sf)).select(KEY, "delay_level")
    return split.stratified_split(df, "delay_level", KEY)


@query("m6_balanced_weights", _FEATURES_BASE + f""",
  d AS (SELECT flight_id, {_level('total_delay')} AS delay_level FROM base),
  c AS (SELECT delay_level, count(*) AS n FROM d GROUP BY 1)
  --- SELECT d.flight_id, d.delay_level,
  cast((SELECT count(*) FROM d) AS double) / ((SELECT count(*) FROM c) * c.n) AS weight
  FROM d JOIN c ON c.delay_level = d.delay_level""")
def _(spark, sf):
    df = _with_total(flights(spark, sf)).select(KEY, "delay_level")
    return split.with_balanced_weight(df, "delay_level")


def _config_recall(i: int, shift: int) -> str:
    hit = f"count(*) FILTER (WHERE {_level('total_delay')} = 3 AND {_level(f'(arr_delay + {shift})')} = 3)"
    return f"""SELECT {i} AS config, {shift} AS shift, CASE WHEN count(*) FILTER (WHERE {_level('total_delay')} = 3) > 0
      THEN cast({hit} AS double) / count(*) FILTER (WHERE {_level('total_delay')} = 3) ELSE 0.0 END AS recall_3 FROM base"""


_SHIFTS = (0, 40, 25, 40)


@query("m9_select_best", _FEATURES_BASE + ", r AS (" + " UNION ALL ".join(
    _config_recall(i, s) for i, s in enumerate(_SHIFTS)) + """)
  --- SELECT config, shift, recall_3 FROM r ORDER BY recall_3 DESC, config LIMIT 1""")
def _(spark, sf):
    df = _with_total(flights(spark, sf))
    tries = [
        evaluate.class_metrics(
            df.select(F.col("delay_level").alias("label"), fn.delay_level(F.col("arr_delay") + s).alias("prediction")))
        .select(F.lit(i).alias("config"), F.lit(s).alias("shift"), "recall_3")
        for i, s in enumerate(_SHIFTS)
    ]
    results = tries[0]
    for one in tries[1:]:
        results = results.unionByName(one)
    return evaluate.select_best(results)


def _report_row(name: str, p: str, r: str, f: str, n: str) -> str:
    return f"SELECT '{name}' AS \"row\", {p} AS precision, {r} AS recall, {f} AS f1, {n} AS support FROM one"


@query("m10_class_report", _PREDICTED + """,
  one AS (SELECT count(*) AS n, avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS acc FROM pred),
  classes(c) AS (VALUES (0), (1), (2), (3)),
  s AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS hit,
    (SELECT count(*) FROM pred WHERE label = c) AS sup,
    (SELECT count(*) FROM pred WHERE prediction = c) AS called FROM classes),
  m AS (SELECT c, sup, CASE WHEN called > 0 THEN cast(hit AS double) / called ELSE 0 END AS p,
    CASE WHEN sup > 0 THEN cast(hit AS double) / sup ELSE 0 END AS r,
    CASE WHEN sup + called > 0 THEN cast(2 * hit AS double) / (sup + called) ELSE 0 END AS f FROM s),
  rows_ AS (SELECT cast(c AS varchar) AS "row", p AS precision, r AS recall, f AS f1, sup AS support FROM m
    UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM one
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), (SELECT n FROM one) FROM m
    UNION ALL SELECT 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup),
      sum(f * sup) / sum(sup), (SELECT n FROM one) FROM m)
  --- SELECT "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
  FROM rows_""")
def class_report(spark, sf):
    report = evaluate.class_report(_predicted(flights(spark, sf)))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("m12_confusion", _PREDICTED + """, classes(c) AS (VALUES (0), (1), (2), (3))
  --- SELECT c AS actual, """ + ", ".join(
    f"(SELECT count(*) FROM pred WHERE label = c AND prediction = {p}) AS predicted_{p}" for p in range(4))
       + " FROM classes")
def _(spark, sf):
    return evaluate.confusion(_predicted(flights(spark, sf)))


@query("m13_regression_report", _PREDICTED + """--- SELECT
  round(sqrt(avg((total_delay - minutes) * (total_delay - minutes))), 9) AS rmse,
  round(1 - avg((total_delay - minutes) * (total_delay - minutes)) / var_pop(total_delay), 9) AS r2,
  count(*) AS n FROM pred""")
def _(spark, sf):
    report = evaluate.regression_report(_predicted(flights(spark, sf)), "total_delay", "minutes")
    return report.withColumns({c: F.round(c, 9) for c in ("rmse", "r2")})


@query("m17_class_text", _FEATURES_BASE + f"""--- SELECT flight_id, CASE {_level('total_delay')}
  WHEN 0 THEN 'Đúng giờ' WHEN 1 THEN 'Delay nhẹ' ELSE 'Delay nặng' END AS class_text,
  cast(floor(greatest(0.25, (o_wspd % 7) / 8.0, (d_wspd % 5) / 8.0) * 100 + 0.5) AS int) AS percent FROM base""")
def _(spark, sf):
    df = _with_total(flights(spark, sf))
    p = F.array(F.lit(0.25), F.col("o_wspd") % 7 / 8.0, F.col("d_wspd") % 5 / 8.0)
    return df.select(KEY, fn.class_text("delay_level").alias("class_text"), fn.winning_percent(p).alias("percent"))
