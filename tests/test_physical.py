"""Shape of the physical plans."""

import pytest

import __spark_entry__ as contract
from airstats.plans.sampling import draw, with_strata

QUERIES = contract.queries()
RELATIONAL = [n for n in sorted(contract.oracle_sql()) if n[0] in "apcf"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_joins_and_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert operator not in text


def test_airports_read_flights_once(spark, flights):
    from airstats.operators.airports import airport_counts

    text = plan(airport_counts(flights))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "arr_delay" not in text


def test_sample_shuffles_candidates_only(spark, flights):
    text = plan(draw(with_strata(flights), "flight_id"))
    # The bound of the race is applied in the scan's own stage, below the one shuffle of rows.
    assert text.index("Window") < text.index("Exchange hashpartitioning(month") < text.index("_last_bin")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_features_do_not_shuffle_rows(spark, flights):
    from airstats.operators.features import build_features

    text = plan(build_features(flights, ["flight_id"], fit_on="all"))
    main = text[:text.index("Subquery")] if "Subquery" in text else text
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning(flight_id" not in main


def test_split_does_not_shuffle_rows(spark, flights):
    from airstats.operators.features import with_targets
    from airstats.operators.split import stratified_split

    text = plan(stratified_split(with_targets(flights), "delay_level", "flight_id"))
    assert "Exchange hashpartitioning" not in text and "Window" not in text


def test_months_are_pushed_down(spark, flights):
    from airstats.operators.filters import scan_months

    text = plan(scan_months(flights, (1, 7), ["op_carrier"]))
    assert "PushedFilters: [In(month, [1,7])]" in text and "ReadSchema: struct<op_carrier:string,month:int>" in text


def test_profile_scans_and_counts_once(spark, flights):
    from airstats.operators.profile import value_profile

    df = value_profile(flights, ["origin", "fl_date"])
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_sampling_log_does_not_read_the_population(spark, flights):
    from airstats.operators.strata import sampling_log
    from airstats.plans.sampling import draw_counted

    drawn = draw_counted(with_strata(flights), "flight_id")
    text = plan(sampling_log(drawn.available, drawn.rows.limit(0)))
    assert "arr_delay" not in text and "last-bins" in text


def test_out_of_fold_means_are_one_aggregate(spark, flights):
    from airstats.operators import features

    rows = features.with_targets(flights)
    sums = features.out_of_fold_sums(rows, ["dest"], "total_delay", "flight_id")
    text = plan(features.with_out_of_fold_mean(rows, sums, ["dest"], "te_dest", "flight_id"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning(dest" not in text
