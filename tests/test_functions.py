"""Edges of the column expressions."""

import pytest
from pyspark.sql import functions as F

from airstats import functions as fn


def values(spark, expr, data, data_type="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {data_type}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_year_and_month_of(spark):
    dates = ["2023-01-05", "2023-7-1", "x2023-01-01", "20230105", None, "", "2023-123-1", "ab-09-cd"]
    assert values(spark, fn.year_of, dates) == [2023, 2023, None, 2023, None, None, 2023, None]
    assert values(spark, fn.month_of, dates) == [1, 7, 1, None, None, None, None, 9]


def test_to_number(spark):
    texts = ["12", " 3.5 ", "-1e2", ".5", "1d", "inf", "NaN", "n/a", "", None]
    assert values(spark, fn.to_number, texts) == [12, 3.5, -100, 0.5, 0, 0, 0, 0, 0, 0]
    assert values(spark, lambda c: fn.to_number(c, None), texts)[4:] == [None] * 6


def test_hours(spark):
    assert values(spark, fn.hhmm_hour, ["0630", "630.0", "2359", "59", "n/a", None, "-50"]) == [6, 6, 23, 0, 0, 0, -1]
    stamps = ["2023-03-12 02:30:00", "06:30", "2023-01-01T23:00:00", "n/a", None]
    assert values(spark, fn.datetime_hour, stamps) == [2, 6, 23, 12, 12]
    assert values(spark, lambda c: fn.dep_hour(c, "auto"), ["0630", "2023-01-01 07:10:00", "n/a"]) == [6, 7, 0]
    assert values(spark, lambda c: fn.dep_hour(c, "auto", 12), ["0630", "2023-01-01 07:10:00", "n/a", None]) == [6, 7, 12, 12]
    with pytest.raises(ValueError):
        fn.dep_hour("x", "other")


def test_hour_does_not_depend_on_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # This wall-clock time does not exist in that zone.
        assert values(spark, fn.datetime_hour, ["2023-03-12 02:30:00"]) == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_calendar(spark):
    assert values(spark, fn.iso_weekday, ["2023-01-01", "2023-01-02", "bad", None]) == [7, 1, None, None]
    assert values(spark, fn.calendar_month, ["2023-12-31", "bad"]) == [12, None]
    assert values(spark, fn.is_weekend, [5, 6, 7, None], "int") == [0, 1, 1, 0]
    months = [1.0, 3.9, 8.0, 11.0, 12.0, 13.0, 0.0, None, float("nan")]
    assert values(spark, fn.season, months, "double") == [
        "Winter", "Spring", "Summer", "Fall", "Winter", "Winter", "Winter", "Unknown", "Unknown"]
    assert values(spark, fn.season, ["4", "x", "3.0"]) == ["Spring", "Unknown", "Unknown"]
    assert values(spark, fn.time_of_day, [0, 5, 6, 11, 12, 17, 18, 23, None], "int") == [
        0, 0, 1, 1, 2, 2, 3, 3, None]
    assert values(spark, fn.is_peak, [5, 6, 9, 10, 15, 16, 19, 20, None], "int") == [
        False, True, True, False, False, True, True, False, False]


def test_delay_edges(spark):
    minutes = [-1000.0, -999.0, -998.0, 0.0, 0.5, 30.0, 31.0, 60.0, 61.0, 99999.0, 100000.0, None]
    assert values(spark, fn.delay_group, minutes, "double") == [
        None, None, "OnTime", "OnTime", "Minor", "Minor", "Moderate", "Moderate", "Severe", "Severe", None, None]
    assert values(spark, fn.delay_level, [-5.0, 0.0, 0.1, 45.0, 45.1, 90.0, 90.1, None], "double") == [
        0, 0, 1, 1, 2, 2, 3, 3]
    assert values(spark, fn.quota_of, ["Severe", "Moderate", "Minor", "OnTime"]) == [50, 100, 150, 200]


def test_report_expressions(spark):
    arrays = [[0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [1.0]]
    assert values(spark, fn.argmax, arrays, "array<double>") == [1, 0, 0]
    assert values(spark, fn.winning_percent, [[0.125, 0.005], [0.665]], "array<double>") == [13, 67]
    assert values(spark, fn.class_text, [0, 1, 2, 3], "int") == ["Đúng giờ", "Delay nhẹ", "Delay nặng", "Delay nặng"]
    assert values(spark, fn.first_token, ["AA (American)", "DL"]) == ["AA", "DL"]
    assert values(spark, fn.code_text, ["JFK", None]) == ["JFK", "nan"]
    assert values(spark, fn.marker_size, [4, 9], "int") == [16.0, 24.0]


def test_hash_is_the_same_anywhere(spark):
    df = spark.range(1000).select(fn.uniform(fn.hash52(fn.key_text("id"), 42)).alias("u"), "id")
    a = {r.id: r.u for r in df.repartition(1).collect()}
    b = {r.id: r.u for r in df.repartition(7).collect()}
    assert a == b and all(0 < u < 1 for u in a.values())
    assert abs(sum(a.values()) / 1000 - 0.5) < 0.05
