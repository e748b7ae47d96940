"""CSV scan, partitioned table, ledger, listing, drifting files, stream."""

import os

import pytest
from pyspark.sql import functions as F, types as T

from airstats.schema import FLIGHT_SCHEMA
from airstats.sources import csv, parquet
from airstats.streaming.ingest import stream_ingest

HEADER = "FL_DATE,OP_CARRIER,ORIGIN,DEST,DEP_DELAY,OP_CARRIER_FL_NUM,MONTH"


def write(folder, name, *lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(folder)


@pytest.fixture
def raw(tmp_path):
    return write(
        tmp_path / "raw", "a.csv",
        "2023-01-05,AA,JFK,LAX,5.5,1,1",
        "2023-02-05,NA,JFK,LAX,NA,2,2",
        "2023-02-06,DL,null,LAX,\\N,3,2",
        "2023-03-07,DL,ATL,LAX,NaN,,3",
        "2023-03-07,DL,ATL,LAX,abc,4,3",
        "2023-03-08,DL,ATL,LAX,1.0,5.0,3",
        '2023-04-08,"A,""B""",ATL,LAX,inf?,6,x',
        "2023-05-08,UA,SFO",
        "2024-01-01,UA,SFO,LAX,n/a,9,1",
    )


def test_null_texts_and_rejects(spark, raw):
    scan = csv.read_flights_csv(spark, raw)
    good = {r.OP_CARRIER_FL_NUM: r for r in scan.good.collect()}
    assert set(good) == {1, 2, 3, None, 9}
    assert good[1].DEP_DELAY == 5.5 and good[2].OP_CARRIER is None and good[3].ORIGIN is None
    assert all(good[k].DEP_DELAY is None for k in (2, 3, None, 9))
    bad = sorted(tuple(r[csv.BAD_COLUMNS]) for r in scan.rejects.collect())
    assert bad == [("DEP_DELAY",), ("DEP_DELAY", "MONTH"), ("OP_CARRIER_FL_NUM",), (csv.BROKEN_LINE,)]
    assert [f.dataType for f in scan.good.schema if f.name == "DEP_DELAY"] == [T.FloatType()]


def test_rows_do_not_depend_on_the_columns_asked_for(spark, raw):
    scan = csv.read_flights_csv(spark, raw)
    assert scan.good.select("FL_DATE").count() == scan.good.count() == len(scan.good.collect()) == 5
    assert scan.rejects.count() == 4


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path / "raw", "a.csv", "7,2023-01-05,z", header="OP_CARRIER_FL_NUM,FL_DATE,EXTRA")
    row = csv.read_flights_csv(spark, path).good.head()
    assert row.OP_CARRIER_FL_NUM == 7 and row.FL_DATE == "2023-01-05" and row.EXTRA == "z"


def test_load_skips_and_replaces(spark, raw, tmp_path):
    table = str(tmp_path / "table")
    assert parquet.load_years(spark, raw, table, [2023]) == [2023]
    assert parquet.load_years(spark, raw, table, [2023]) == []
    assert spark.read.parquet(table).count() == 2
    assert parquet.load_years(spark, raw, table, [2023, 2024]) == [2024]
    assert parquet.load_years(spark, raw, table, [2023], force=True) == [2023]
    loaded = spark.read.parquet(table)
    assert sorted((r.year, r.month) for r in loaded.collect()) == [(2023, 1), (2023, 3), (2024, 1)]
    pruned = loaded.where("month = 3 AND year = 2023").select("ORIGIN")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "ReadSchema: struct<ORIGIN:string>" in plan


def test_listing_and_ledger(spark, raw, tmp_path):
    table, book = str(tmp_path / "table"), str(tmp_path / "ledger")
    parquet.load_years(spark, raw, table, [2023])
    first = parquet.update_ledger(spark, table, book).head()
    assert first.processed_years == [2023] and first.total_rows == 2 and set(first.file_sizes) == {"2023"}
    parquet.load_years(spark, raw, table, [2024])
    second = parquet.update_ledger(spark, table, book).head()
    assert second.processed_years == [2023, 2024] and second.total_rows == 3
    assert second.processing_date == first.processing_date and second.last_updated > first.last_updated
    listing = {r.year: r for r in parquet.partition_listing(spark, table).collect()}
    assert listing[2023].files == 2 and listing[2023].rows == 2 and listing[2023].bytes > 0


def test_a_large_month_is_split_among_tasks(spark, tmp_path):
    df = spark.range(200_000, numPartitions=8).select(
        F.lit(2023).alias("year"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("month"),
        F.md5(F.col("id").cast("string")).alias("text"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        parquet.write_partitioned(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size or "64MB")
    assert len(list((tmp_path / "t" / "year=2023" / "month=1").glob("*.parquet"))) > 1


def test_drifting_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "month int, c string").coalesce(1).write.parquet(f"{path}/x=1")
    spark.createDataFrame([("2", "b")], "month string, c string").coalesce(1).write.parquet(f"{path}/x=2")
    spark.createDataFrame([(3,)], "month int").coalesce(1).write.parquet(f"{path}/x=3")
    schema = T.StructType([T.StructField("month", T.IntegerType()), T.StructField("c", T.StringType())])
    assert [tuple(r) for r in parquet.read_conforming(spark, path, schema).collect()] == [(1, "a")]
    types = {(r.column, r.type): r.files for r in parquet.type_profile(spark, path, ["MONTH"]).collect()}
    assert types == {("month", "int32"): 2, ("month", "string"): 1}


def test_stream_loads_each_file_once(spark, tmp_path):
    src, dst, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(src, "a.csv", "2023-01-05,AA,JFK,LAX,5.5,1,1", "2023-01-06,AA,JFK,LAX,bad,2,1")
    stream_ingest(spark, str(src), dst, state).awaitTermination()
    write(src, "b.csv", "2023-01-07,AA,JFK,LAX,NA,3,1", "2024-02-07,AA,JFK,LAX,1,4,2")
    for _ in range(2):
        stream_ingest(spark, str(src), dst, state, files_per_load=1).awaitTermination()
    loaded = spark.read.parquet(dst)
    assert sorted((r.OP_CARRIER_FL_NUM, r.year, r.month, int(r.load.split("-")[1])) for r in loaded.collect()) == [
        (1, 2023, 1, 0), (3, 2023, 1, 1), (4, 2024, 2, 1)]


def test_schema_has_34_columns():
    assert len(FLIGHT_SCHEMA) == 34
    assert [f.name for f in FLIGHT_SCHEMA if f.dataType == T.IntegerType()] == [
        "OP_CARRIER_FL_NUM", "FLIGHTS", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "ORIGIN_INDEX", "DEST_INDEX"]


def test_files_with_another_header_are_refused(spark, tmp_path):
    write(tmp_path / "raw", "a.csv", "2023-01-05,AA", header="FL_DATE,OP_CARRIER")
    path = write(tmp_path / "raw", "b.csv", "AA,2023-01-05", header="OP_CARRIER,FL_DATE")
    with pytest.raises(Exception, match="header"):
        csv.read_flights_csv(spark, path).good.collect()


def test_conforming_reads_times_decimals_and_partitions(spark, tmp_path, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert parquet.read_conforming(spark, f"{sf_dir}/orders.parquet", orders.schema).count() == orders.count()
    path = str(tmp_path / "by_year")
    rows = spark.range(20).selectExpr("id", "cast(id as decimal(10,2)) as price", "timestamp'2024-01-01 00:00:00' as at",
                                      "cast(2000 + id % 2 as int) as year")
    rows.write.partitionBy("year").parquet(path)
    assert sorted(parquet.read_conforming(spark, path, rows.schema).collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        parquet.read_conforming(spark, path, rows.selectExpr("array(id) as id").schema)


def test_forced_load_drops_months_the_source_lost(spark, tmp_path):
    dst = str(tmp_path / "table")
    january, march, other = "2023-01-05,AA,JFK,LAX,5.5,1,1", "2023-03-07,DL,ATL,LAX,1.0,4,3", "2022-03-07,DL,ATL,LAX,1.0,4,3"
    parquet.load_years(spark, write(tmp_path / "whole", "a.csv", january, march, other), dst, [2022, 2023])
    parquet.load_years(spark, write(tmp_path / "less", "a.csv", march), dst, [2023], force=True)
    got = {(r.year, r.month) for r in spark.read.parquet(dst).select("year", "month").collect()}
    assert got == {(2022, 3), (2023, 3)}


def test_two_feeds_into_one_table(spark, tmp_path):
    dst = str(tmp_path / "table")
    for name, line in (("one", "2023-01-05,AA,JFK,LAX,5.5,1,1"), ("two", "2023-01-06,DL,ATL,LAX,1.0,4,1")):
        stream_ingest(spark, write(tmp_path / name, "a.csv", line), dst, str(tmp_path / f"check-{name}")).awaitTermination()
    assert {r.OP_CARRIER for r in spark.read.parquet(dst).select("OP_CARRIER").collect()} == {"AA", "DL"}


def balance(counts, quarantine):
    """Lines add up, and the quarantine has those that were not loaded."""
    kept = {r.outcome: r["count"] for r in quarantine.groupBy("outcome").count().collect()}
    assert counts["lines"] == counts["loaded"] + counts["rejected"] + counts["dropped"] + counts["other_year"]
    assert kept == {k: counts[k] for k in ("rejected", "dropped") if counts[k]}


def test_load_accounts_for_every_line(spark, raw, tmp_path):
    dst, held = str(tmp_path / "table"), str(tmp_path / "held")
    done = parquet.load(spark, raw, dst, [2023], quarantine=held)
    assert done.years == [2023]
    # two flights, five lines with a fault or a field missing, one without an origin, one of another year
    assert done.counts == {"lines": 9, "loaded": 2, "rejected": 4, "dropped": 2, "other_year": 1}
    lines = spark.read.parquet(held)
    balance(done.counts, lines)
    count = lines.count()
    assert {r.line for r in lines.where("outcome = 'rejected'").collect()} >= {"2023-03-07,DL,ATL,LAX,abc,4,3", "2023-05-08,UA,SFO"}
    dropped = {r.line for r in lines.where("outcome = 'dropped'").collect()}
    assert any(line.startswith("2023-02-06,DL,,LAX") for line in dropped)
    assert parquet.load(spark, raw, dst, [2023], quarantine=held) == ([], None)
    again = parquet.load(spark, raw, dst, [2023], force=True, quarantine=held)
    assert again == done and spark.read.parquet(held).count() == count and spark.read.parquet(dst).count() == 2
    assert parquet.loaded_years(spark, dst) == {2023} and parquet.loaded_years(spark, str(tmp_path / "none")) == set()


def test_load_with_quarantine_types_the_source_once(spark, raw, tmp_path, monkeypatch):
    whole, read = parquet.write_quarantine, []

    def noted(rows, *args):
        read.extend(rows.inputFiles())
        whole(rows, *args)

    monkeypatch.setattr(parquet, "write_quarantine", noted)
    parquet.load(spark, raw, str(tmp_path / "table"), [2023], quarantine=str(tmp_path / "held"))
    assert read and all(f.endswith(".parquet") for f in read)  # not the lines again
    assert not any(os.path.exists(f.removeprefix("file://")) for f in read)
    plan = csv.judged(csv.flight_lines(spark, raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 2


def test_stream_accounts_for_every_line(spark, tmp_path):
    src, dst, held, book = tmp_path / "in", *(str(tmp_path / n) for n in ("out", "held", "book"))
    args = dict(quarantine=held, loads=book)
    write(src, "a.csv", "2023-01-05,AA,JFK,LAX,5.5,1,1", "2023-01-06,AA,JFK,LAX,bad,2,1", "n/a,AA,JFK,LAX,1,3,1")
    stream_ingest(spark, str(src), dst, str(tmp_path / "state"), **args).awaitTermination()
    write(src, "b.csv", "2023-01-07,AA,JFK,LAX,NA,3,1", "2023-01-07,AA,JFK")
    for _ in range(2):
        stream_ingest(spark, str(src), dst, str(tmp_path / "state"), **args).awaitTermination()
    loads = spark.read.parquet(book)
    assert sorted((r.lines, r.loaded, r.rejected, r.dropped) for r in loads.collect()) == [(2, 1, 1, 0), (3, 1, 1, 1)]
    total = loads.selectExpr(*[f"sum({c}) AS {c}" for c in ("lines", *parquet.OUTCOMES)]).head().asDict()
    balance(total, spark.read.parquet(held))
    assert spark.read.parquet(dst).count() == total["loaded"]


def test_a_batch_under_way_again_replaces_its_own(spark, tmp_path, monkeypatch):
    """The second try of a batch that failed behind its first sink adds nothing."""
    from airstats.streaming import ingest

    src, dst, held = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "held")
    write(src, "a.csv", "2023-01-05,AA,JFK,LAX,5.5,1,1", "2023-01-06,AA,JFK,LAX,bad,2,1")
    args = dict(quarantine=held, key=ingest.FLIGHT_KEY)
    whole = ingest.write_quarantine

    def failing(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "write_quarantine", failing)
    with pytest.raises(Exception, match="lost"):
        stream_ingest(spark, str(src), dst, str(tmp_path / "state"), **args).awaitTermination()
    monkeypatch.setattr(ingest, "write_quarantine", whole)
    stream_ingest(spark, str(src), dst, str(tmp_path / "state"), **args).awaitTermination()
    assert spark.read.parquet(dst).count() == 1 and spark.read.parquet(held).count() == 1


def test_a_flight_delivered_twice_is_loaded_once(spark, tmp_path):
    from airstats.streaming.ingest import FLIGHT_KEY

    src, dst = tmp_path / "in", str(tmp_path / "out")
    first = ("2023-01-05,AA,JFK,LAX,5.5,1,1", "2023-02-05,DL,JFK,LAX,1,,2", "2023-02-05,DL,JFK,LAX,1,,2")
    write(src, "a.csv", *first)
    stream_ingest(spark, str(src), dst, str(tmp_path / "state"), key=FLIGHT_KEY).awaitTermination()
    write(src, "b.csv", *first, "2023-01-05,AA,JFK,SFO,5.5,1,1", "2024-01-05,AA,JFK,LAX,5.5,1,1")
    stream_ingest(spark, str(src), dst, str(tmp_path / "state"), key=FLIGHT_KEY).awaitTermination()
    got = sorted((r.FL_DATE, r.OP_CARRIER, r.DEST) for r in spark.read.parquet(dst).collect())
    assert got == [("2023-01-05", "AA", "LAX"), ("2023-01-05", "AA", "SFO"), ("2023-02-05", "DL", "LAX"), ("2024-01-05", "AA", "LAX")]
    # the same folder as another feed
    stream_ingest(spark, str(src), dst, str(tmp_path / "other"), key=FLIGHT_KEY).awaitTermination()
    assert spark.read.parquet(dst).count() == 4


def test_conforming_reads_columns_that_stand_in_file_and_path(spark, tmp_path):
    path = str(tmp_path / "year=1" / "table")  # a folder above the table names no column
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("year", T.IntegerType())])
    rows = spark.createDataFrame([(1, 2023), (2, 2023), (3, 2023)], schema)
    rows.coalesce(1).write.parquet(f"{path}/year=2023")
    assert sorted(map(tuple, parquet.read_conforming(spark, path, schema).collect())) == [(1, 2023), (2, 2023), (3, 2023)]
    spark.createDataFrame([(4,)], "a int").coalesce(1).write.parquet(f"{path}/year=2024")
    spark.createDataFrame([(5, 2025)], schema).coalesce(1).write.parquet(f"{path}/more")
    spark.createDataFrame([("x",)], "a string").coalesce(1).write.parquet(f"{path}/year=2026")
    spark.createDataFrame([(6,)], "a int").coalesce(1).write.parquet(f"{path}/none")
    got = sorted(map(tuple, parquet.read_conforming(spark, path, schema).collect()))
    assert got == [(1, 2023), (2, 2023), (3, 2023), (4, 2024), (5, 2025)]
    skipped = {r.file.split("/")[-2]: r.faults for r in parquet.skipped_files(spark, path, schema).collect()}
    assert skipped == {"year=2026": ["a: string"], "none": ["year: missing"]}


def test_ledger_merge_counts_only_loaded_years(spark, tmp_path, monkeypatch):
    table, path, book = (str(tmp_path / n) for n in ("table", "ledger", "book"))
    rows = [(y, m, y + m) for y in (2021, 2022) for m in (1, 2)]
    spark.createDataFrame(rows, "year int, month int, a int").write.partitionBy("year", "month").parquet(table)
    first = parquet.merge_ledger(spark, table, path, book, [2021, 2022]).head()
    assert (first.processed_years, first.total_rows, set(first.file_sizes)) == ([2021, 2022], 4, {"2021", "2022"})

    seen, count = [], parquet._per_file
    monkeypatch.setattr(parquet, "_per_file", lambda df: seen.extend(df.inputFiles()) or count(df))
    spark.createDataFrame([(2022, 3, 0)], "year int, month int, a int").write.mode("append").partitionBy(
        "year", "month").parquet(table)
    again = parquet.merge_ledger(spark, table, path, book, [2022]).head()
    assert (again.total_rows, again.processing_date) == (5, first.processing_date)
    assert seen and all("year=2022" in f for f in seen)

    # a year that lost its files is no longer listed
    parquet._delete(spark, [f"{table}/year=2021"])
    gone = parquet.merge_ledger(spark, table, path, book, [2021]).head()
    assert (gone.processed_years, gone.total_rows) == ([2022], 3)


def test_requests_use_the_newest_finished_maps(spark, tmp_path):
    from airstats.streaming import requests

    path = str(tmp_path / "maps")
    with pytest.raises(ValueError):
        requests.load_maps(spark, path)
    totals = spark.createDataFrame([("A", "B", 2)], "origin string, dest string, flights long")
    for mean in (1.0, 2.0):
        requests.save_maps({"dest": spark.createDataFrame([("B", mean)], "dest string, te_dest double")}, totals, path)
    totals.write.parquet(f"{path}/version=3/maps/dest")  # not finished
    maps, routes = requests.load_maps(spark, path)
    assert [r.te_dest for r in maps["dest"].collect()] == [2.0] and routes.count() == 1
    assert requests.save_maps({}, totals, path) == 4


def test_drifted_files_are_widened_by_name(spark, tmp_path):
    from airstats.sources.drift import read_drifted, widens

    path = str(tmp_path / "mixed")
    schema = T._parse_datatype_string("a bigint, tags array<double>, at struct<x:bigint,y:string>, year int")
    nested = ["array(1.5f) as tags", "named_struct('y', 'q', 'X', 2, 'z', true) as at"]
    spark.range(1).selectExpr("cast(1 as int) as A", *nested, "2020 as year").write.partitionBy("year").parquet(path)
    spark.range(1).selectExpr("2L as b", "null as tags", "null as at", "2021 as year").selectExpr(
        "b", "cast(tags as array<double>) tags", "cast(at as struct<x:bigint,y:string>) at", "year").write.parquet(f"{path}/year=2021")
    for bad, kind in (("'x' as a", "text"), ("1.5D as a", "double"), ("1 as c", "none")):
        spark.range(1).selectExpr(bad, *nested, "2022 as year").coalesce(1).write.parquet(f"{path}/{kind}")
    got = read_drifted(spark, path, schema, {"a": ["b"]})
    rows = {r.a: r for r in got.rows.collect()}
    assert got.rows.schema == schema and set(rows) == {1, 2}
    assert rows[1].tags == [1.5] and tuple(rows[1].at) == (2, "q") and rows[1].year == 2020
    assert rows[2].tags is None and rows[2].at is None and rows[2].year == 2021
    assert {r.file.split("/")[-2]: r.faults for r in got.skipped.collect()} == {
        "text": ["a: string"], "double": ["a: double"], "none": ["a: missing"]}
    assert not widens(T.LongType(), T.IntegerType()) and not widens(T.LongType(), T.DoubleType())
    assert widens(T.IntegerType(), T.DecimalType(12, 2)) and not widens(T.IntegerType(), T.DecimalType(10, 2))


def test_drifted_reads_of_one_folder_and_of_none(spark, tmp_path):
    from airstats.sources.drift import read_drifted

    path = str(tmp_path / "shared")
    for rows in ("1 as a", "2L as a", "'x' as a"):
        spark.range(1).selectExpr(rows).coalesce(1).write.mode("append").parquet(path)
    got = read_drifted(spark, path, T._parse_datatype_string("a bigint"))
    assert sorted(r.a for r in got.rows.collect()) == [1, 2] and got.skipped.count() == 1
    (tmp_path / "none").mkdir()
    none = read_drifted(spark, str(tmp_path / "none"), T._parse_datatype_string("a bigint"))
    assert none.rows.count() == 0 and none.skipped.count() == 0


def test_balance_writes_its_lines_once(spark, sf_dir, monkeypatch):
    """The raw lines that a stream is fed with are made once, not again for their header."""
    from airstats.catalog import QUERIES, files

    made, raw_csv = [], files.raw_csv
    monkeypatch.setattr(files, "raw_csv", lambda *args, **more: made.append(more) or raw_csv(*args, **more))
    assert QUERIES["s4_stream_balance"](spark, sf_dir).collect()
    assert made == [{"broken_numbers": True}]
