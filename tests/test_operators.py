"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from airstats.operators import airports, compare, evaluate, features, filters, kpi, profile, rank, split


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_missing_codes(spark):
    df = spark.createDataFrame([(1,), (3,), (3,), (99,), (None,)], "month int")
    assert rows(filters.missing_codes(df, "month", 1, 5), "code") == [(2,), (4,), (5,)]


def test_tolerant_clean_keeps_what_is_there(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, 2.0, 3.0)], "ARR_DELAY double, DEP_DELAY double, O_PRCP double")
    assert rows(filters.clean_for_model(df, tolerant=True)) == []
    zero = filters.clean_for_model(df, "zero", tolerant=True)
    assert zero.columns == ["arr_delay", "dep_delay", "o_prcp"]
    assert rows(zero, "arr_delay") == [(0.0, 2.0, 3.0), (1.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        filters.clean_for_model(df, "other")


def test_top_values_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "v string")
    assert rows(rank.top_values(df, ["v"], 2)) == [("c", 2), ("a", 1)]


def test_group_other_ranks_the_missing_code(spark):
    data = [(None,)] * 3 + [("a",)] * 2 + [("b",)] * 2 + [("c",)]
    df = rank.group_other(spark.createDataFrame(data, "dest string"), "dest", 2)
    assert {r.dest_grouped for r in df.collect()} == {"nan", "a", "OTHER"}


def test_value_profile(spark):
    data = [("x", 1)] * 3 + [("y", 1)] + [(None, 2)] * 4
    got = rows(profile.value_profile(spark.createDataFrame(data, "a string, b int"), ["a", "b"], 1), "column")
    assert got == [("a", 1, "x", 3, 37.5, 2), ("b", 1, "1", 4, 50.0, 2)]


def test_count_bins_edges(spark):
    df = spark.createDataFrame([(10,), (11,), (50,), (1000,), (1001,)], "total_flights long")
    assert [r.airports for r in airports.count_bins(df).orderBy("bin").collect()] == [1, 2, 0, 0, 0, 1]
    assert airports.count_bins(df).agg(F.sum("percent")).head()[0] == pytest.approx(80.0)
    empty = airports.count_bins(df.limit(0)).collect()
    assert [(r.airports, r.percent) for r in empty] == [(0, None)] * 6


def test_count_summary_median_and_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 2)], "code string, total_flights long")
    assert rows(airports.count_summary(df)) == [(25, 6.25, 7.0, 9, "b", 2)]


def test_airport_counts_cover_both_ends(spark, flights):
    complete = flights.where("dest IS NOT NULL AND o_latitude IS NOT NULL")
    total = airports.airport_counts(complete).agg(F.sum("total_flights")).head()[0]
    assert total == 2 * complete.count()


def test_share_compare_inner_hides_and_full_shows(spark):
    pop = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    sam = spark.createDataFrame([("a",), (None,)], "c string")
    assert rows(compare.share_compare(pop, sam, "c")) == [("a", 0.75, 1.0, 0.25)]
    assert rows(compare.share_compare(pop, sam, "c", "full")) == [("a", 0.75, 1.0, 0.25), ("b", 0.25, 0.0, 0.25)]


def test_kpis_of_nothing_and_of_null_carrier(spark, flights):
    nothing = kpi.kpis(flights.limit(0)).head()
    assert nothing.total_flights == 0 and nothing.worst_carrier is None and nothing.airports == 0
    nameless = kpi.kpis(flights.withColumn("op_carrier", F.lit(None).cast("string"))).head()
    assert nameless.total_flights == flights.count() and nameless.worst_carrier is None


def test_route_risk_from_training_rows_only(spark):
    df = spark.createDataFrame(
        [("a", "b", 10.0, "train"), ("a", "b", 90.0, "test"), ("c", "d", 50.0, "test"), (None, "b", 30.0, "train")],
        "origin string, dest string, total_delay double, split string")
    risk = {(r.origin, r.dest, r.split): r.route_risk for r in features.route_risk(df, "train", "split").collect()}
    assert risk[("a", "b", "test")] == 10.0
    assert risk[("c", "d", "test")] == risk[(None, "b", "train")] == 20.0
    leaky = {r.split + str(r.origin): r.route_risk for r in features.route_risk(df, "all").collect()}
    assert leaky["testa"] == 50.0
    with pytest.raises(ValueError):
        features.route_risk(df, "train")


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(features.standardise(df, ["a", "b"]), "a") == [(-1.0, 0.0), (1.0, 0.0)]


def test_encoding_of_unseen_is_mean_of_category_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "c string, y double")
    mapping = features.target_encoding(df, "c", "y")
    asked = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert {r.c: r.te_c for r in features.apply_encoding(asked, mapping, "c").collect()} == {
        "a": 2.0, "z": 6.0, None: 6.0}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(2,)], "y int")
    got = {r.y: r.weight for r in split.with_balanced_weight(df, "y").collect()}
    assert got == {0: pytest.approx(4 / 6), 2: pytest.approx(2.0)}


@pytest.mark.parametrize("sizes", [(10, 5, 3, 2), (1, 1, 1, 1), (997, 3), (7,)])
def test_split_sizes_are_exact(spark, sizes):
    data = [(f"{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "id string, y int")
    got = split.stratified_split(df, "y", "id")
    counts = {(r.y, r.split): r["count"] for r in got.groupBy("y", "split").count().collect()}
    tests = [counts.get((c, "test"), 0) for c in range(len(sizes))]
    assert sum(tests) == -(-sum(sizes) * 2 // 10)
    for n, t in zip(sizes, tests):
        assert abs(t - 0.2 * n) < 1.5
    again = split.stratified_split(df.repartition(5), "y", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_split_divides_bins_of_many_rows(spark, monkeypatch):
    df = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    expected = sorted(map(tuple, split.stratified_split(df, "y", "id").collect()))
    levels, counted = [], split._counted
    monkeypatch.setattr(split, "_counted", lambda keys, label, bits: (levels.append(bits), counted(keys, label, bits))[1])
    monkeypatch.setattr(split, "_BIN_BITS", 3)
    monkeypatch.setattr(split, "_EDGE_ROWS", 20)
    assert sorted(map(tuple, split.stratified_split(df, "y", "id").collect())) == expected
    assert levels[:3] == [3, 6, 9]


def test_encodings_of_one_pass_equal_single_ones(spark):
    rows = [("a", "x", 1), ("a", "y", 4), ("b", "y", None), (None, "x", 7), ("b", None, 2), ("c", "x", None)]
    df = spark.createDataFrame(rows, "c string, d string, y int")
    for c, mapping in features.target_encodings(df, ["c", "d"], "y").items():
        assert sorted(map(tuple, mapping.collect())) == sorted(map(tuple, features.target_encoding(df, c, "y").collect()))


def test_class_report_of_absent_classes_is_zero(spark):
    preds = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0)], "label int, prediction double")
    report = {r["row"]: r for r in evaluate.class_report(preds).collect()}
    assert (report["3"].precision, report["3"].recall, report["3"].f1, report["3"].support) == (0, 0, 0, 0)
    assert report["0"].precision == 1.0 and report["0"].recall == 0.5
    assert report["accuracy"].f1 == pytest.approx(2 / 3)
    matrix = evaluate.confusion(preds).collect()
    assert len(matrix) == 4 and matrix[0].predicted_1 == 1 and matrix[3].predicted_3 == 0


def test_regression_report_of_constant_target(spark):
    right = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    wrong = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert evaluate.regression_report(right).head().r2 == 1.0
    assert evaluate.regression_report(wrong).head().r2 == 0.0


def test_select_best_takes_the_first_of_equals_and_skips_failures(spark):
    df = spark.createDataFrame([(0, None), (1, 0.4), (2, 0.6), (3, 0.6)], "config int, recall_3 double")
    assert evaluate.select_best(df).head().config == 2


def test_split_keeps_copies_of_a_key_together(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit(0).alias("y"))
    got = split.stratified_split(df, "y", "id")
    assert got.count() == 3000
    assert got.groupBy("id").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).head()[0] == 1
    copies = got.where("id = -1").select("split").distinct().head().split
    tests = got.where("split = 'test'").count()
    assert tests == 600 if copies == "train" else 600 <= tests <= 1600
