"""The stratified weighted sample."""

import math

import pytest
from pyspark.sql import functions as F

from airstats.operators.strata import stratified_sample
from airstats.plans.sampling import draw, sample_flights, validate_sample, with_strata


def by_hand(rows, quota, seed):
    """The race run in plain Python over one stratum."""
    import hashlib

    def race(row):
        h = int(hashlib.md5(f"{seed}|{row['id']}".encode()).hexdigest()[:13], 16)
        hit = -math.log((h + 0.5) / 2**52)
        return (hit / row["w"] if row["w"] > 0 else math.inf, hit)

    return {r["id"] for r in sorted(rows, key=race)[:quota]}


@pytest.mark.parametrize("n,quota", [(5, 10), (10, 10), (500, 10), (500, 499), (500, 0)])
def test_equals_brute_force(spark, n, quota):
    rows = [{"id": i, "g": "a", "w": float(i % 4)} for i in range(n)]
    df = spark.createDataFrame(rows, "id int, g string, w double")
    for parts in (1, 7):
        got = stratified_sample(df.repartition(parts), ["g"], F.lit(quota), "w", "id", 7)
        assert {r.id for r in got.collect()} == by_hand(rows, quota, 7)


def test_no_weight_at_all_still_fills_the_quota(spark):
    df = spark.range(1000).withColumns({"g": F.lit("a"), "w": F.lit(0.0)})
    assert stratified_sample(df, ["g"], F.lit(20), "w", "id").count() == 20


def test_weight_that_is_no_number_counts_as_none(spark):
    df = spark.range(100).withColumns({"g": F.lit("a"), "w": F.when(F.col("id") < 50, 1.0).otherwise(float("nan"))})
    got = stratified_sample(df, ["g"], F.lit(45), "w", "id")
    assert got.count() == 45 and got.where("id >= 50").isEmpty()


def test_hot_stratum_and_null_stratum(spark):
    df = spark.range(30_000).withColumn(
        "g", F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 3 == 1, "hot").otherwise(F.lit(None)))
    got = stratified_sample(df.withColumn("w", F.lit(1.0)), ["g"], F.lit(100), "w", "id")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"small": 100, "hot": 100}


def test_heavier_rows_are_drawn_more_often(spark):
    df = spark.range(400).withColumns({"g": F.lit("a"), "w": F.when(F.col("id") < 200, 1.0).otherwise(4.0)})
    heavy = sum(
        stratified_sample(df, ["g"], F.lit(40), "w", "id", seed).where("id >= 200").count() for seed in range(8))
    assert 0.7 < heavy / (8 * 40) < 0.9


def test_only_candidates_are_shuffled(spark, flights):
    scored = with_strata(flights)
    # Every quota, and each month's group, is met exactly or taken whole.
    counts = draw(scored, "flight_id").groupBy("month", "delay_group").count()
    available = scored.where("delay_group IS NOT NULL").groupBy("month", "delay_group").count()
    quota = {"Severe": 50, "Moderate": 100, "Minor": 150, "OnTime": 200}
    drawn = {(r.month, r.delay_group): r["count"] for r in counts.collect()}
    for r in available.collect():
        assert drawn[(r.month, r.delay_group)] == min(quota[r.delay_group], r["count"])


def test_whole_run(spark, flights):
    result = sample_flights(flights, "flight_id")
    n = result.sample.count()
    assert result.log.agg(F.sum("sampled")).head()[0] == n
    assert result.log.agg(F.sum("available")).head()[0] == flights.where("arr_delay IS NOT NULL").count()
    assert result.shares.agg(F.sum("share")).head()[0] == pytest.approx(1.0)
    assert 0 < result.coverage.head().coverage <= 1
    tables = validate_sample(flights, result.sample)
    assert tables.carriers.count() == 5
    assert tables.missing.count() == 0
    for chart in (tables.carrier_chart, tables.airport_chart, tables.hour_chart):
        sums = {r.type: r.s for r in chart.groupBy("type").agg(F.sum("share").alias("s")).collect()}
        assert sums == {"Population": pytest.approx(1.0), "Sample": pytest.approx(1.0)}
    assert tables.peak.head().diff < 0.2


def test_a_key_with_many_copies(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"),
        (F.col("id") % 2).alias("g"), F.lit(1.0).alias("w"))
    got = stratified_sample(df, ["g"], F.lit(50), "w", "id", 5, max_quota=50)
    assert got.count() == 100
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
