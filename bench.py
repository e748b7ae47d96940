"""Time the headline queries; prints one JSON line.

Every query runs once cold and then warm; the warm median counts. Ingest loads the flights,
written as CSV, several times over in one scan, so that its rate is that of the work and not of
starting it; its rows per second compare with the published load of a whole year.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_RUNS = int(os.environ.get("BENCH_RUNS", "3"))
INGEST_COPIES = 20
PUBLISHED_ROWS_PER_SEC = 139_000

HEADLINE = (
    "s7_scan_months", "p5_clean_for_model", "a1_value_profile", "a2_airport_statistics",
    "a3_count_summary", "a4_count_bins", "a5_top_airports", "a6_priority_score",
    "a7_stratified_sample", "a8_sampling_log", "a9_share_compare", "a11_hour_distribution",
    "a12_peak_compare", "a15_kpis", "a16_monthly_trend", "a17_route_ranking", "f6_route_risk",
    "f10_build_features", "f12_target_encoding", "f14_serving_features", "m1_stratified_split",
    "m6_balanced_weights", "m10_class_report", "m13_regression_report",
)
FITS = ("m2_fit_linear", "m3_fit_logistic", "m5_fit_boosted")


def shuffled_bytes(spark: SparkSession) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from airstats.catalog import QUERIES
    from airstats.catalog.files import raw_csv
    from airstats.sources.parquet import load_years
    from airstats.storage import scratch_path

    cold, warm, shuffled = {}, {}, {}
    for name in HEADLINE:
        query = QUERIES[name]
        cold[name] = round(seconds(lambda: run(query(spark, SF_DIR))), 3)
        before = shuffled_bytes(spark)
        times = [seconds(lambda: run(query(spark, SF_DIR))) for _ in range(WARM_RUNS)]
        shuffled[name] = (shuffled_bytes(spark) - before) // WARM_RUNS
        warm[name] = round(statistics.median(times), 3)
    for name in FITS:
        warm[name] = cold[name] = round(seconds(lambda: run(QUERIES[name](spark, SF_DIR))), 3)

    source = [raw_csv(spark, SF_DIR)] * INGEST_COPIES
    target = ""

    def ingest() -> None:
        nonlocal target
        target = scratch_path(spark, "bench")
        load_years(spark, source, target, range(1900, 2100))

    cold["ingest"] = round(seconds(ingest), 3)
    warm["ingest"] = round(statistics.median(seconds(ingest) for _ in range(2)), 3)
    rows = spark.read.parquet(target).count()
    rate = rows / warm["ingest"]

    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": SF_DIR.rsplit("sf", 1)[-1], "cold": cold, "shuffle_bytes": shuffled,
        "ingest_rows": rows, "ingest_rows_per_sec": round(rate),
        "ingest_vs_published": round(rate / PUBLISHED_ROWS_PER_SEC, 2), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
