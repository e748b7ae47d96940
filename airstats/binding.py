"""Flights derived from the orders, lineitem, customer and nation tables.

One row per order. ``flights`` builds it with DataFrames, ``FLIGHTS_SQL`` is the same table as
SQL text for a check in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY = "flight_id"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zero_padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ship = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("fs"), F.max("l_shipdate").alias("ls"),
        F.max("l_discount").alias("mxd"), F.min("l_tax").alias("mnt"),
        F.min("l_quantity").alias("mnq"), F.max("l_quantity").alias("mxq"),
        F.sum("l_quantity").alias("sq"),
    )
    joined = (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    order, cust, origin_no = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    date = F.col("o_orderdate").cast("date")
    dest_no = (order * 7 + cust) % 25

    def text_unless(every: int, text: Column, other: str | None) -> Column:
        return F.when(order % every == 0, F.lit(other).cast("string")).otherwise(text)

    return joined.select(
        order.alias("flight_id"),
        date.cast("string").alias("fl_date"),
        F.concat(F.lit("C"), _zero_padded(cust % 17, 2)).alias("op_carrier"),
        F.col("n_name").alias("origin"),
        text_unless(89, F.concat(F.lit("NATION_"), dest_no.cast("string")), None).alias("dest"),
        text_unless(53, F.concat(date.cast("string"), F.lit(" "), _zero_padded(order % 24, 2),
                                 F.lit(":15:00")), "n/a").alias("crs_dep_time"),
        text_unless(61, _zero_padded((order % 24) * 100 + cust % 60, 4), "n/a").alias("dep_time"),
        F.floor(F.date_diff("fs", date) / 8.0).cast("double").alias("arr_delay"),
        F.floor(F.date_diff("ls", date) / 16.0).cast("double").alias("dep_delay"),
        F.col("sq").cast("double").alias("crs_elapsed_time"),
        F.col("mxd").alias("o_prcp"), F.col("mxq").alias("o_wspd"),
        F.col("mnt").alias("d_prcp"), F.col("mnq").alias("d_wspd"),
        F.month(date).alias("month"),
        (F.weekday(date) + 1).alias("day_of_week"),
        F.when(order % 97 == 0, None).otherwise((20 + (origin_no * 7) % 35).cast("double")).alias("o_latitude"),
        (-130 + (origin_no * 11) % 65).cast("double").alias("o_longitude"),
        (20 + (dest_no * 7) % 35).cast("double").alias("d_latitude"),
        (-130 + (dest_no * 11) % 65).cast("double").alias("d_longitude"),
        ((order + origin_no) % 41 - 5).cast("double").alias("o_temp"),
        ((order + dest_no) % 37 - 3).cast("double").alias("d_temp"),
    )


FLIGHTS_SQL = """
ship AS (
  SELECT l_orderkey, min(l_shipdate) AS fs, max(l_shipdate) AS ls, max(l_discount) AS mxd,
         min(l_tax) AS mnt, min(l_quantity) AS mnq, max(l_quantity) AS mxq, sum(l_quantity) AS sq
  FROM lineitem GROUP BY l_orderkey),
flights AS (
  SELECT o.o_orderkey AS flight_id,
    cast(cast(o.o_orderdate AS date) AS varchar) AS fl_date,
    concat('C', lpad(cast(o.o_custkey % 17 AS varchar), 2, '0')) AS op_carrier,
    n.n_name AS origin,
    CASE WHEN o.o_orderkey % 89 = 0 THEN NULL
         ELSE concat('NATION_', cast((o.o_orderkey * 7 + o.o_custkey) % 25 AS varchar)) END AS dest,
    CASE WHEN o.o_orderkey % 53 = 0 THEN 'n/a'
         ELSE concat(cast(cast(o.o_orderdate AS date) AS varchar), ' ',
                     lpad(cast(o.o_orderkey % 24 AS varchar), 2, '0'), ':15:00') END AS crs_dep_time,
    CASE WHEN o.o_orderkey % 61 = 0 THEN 'n/a'
         ELSE lpad(cast((o.o_orderkey % 24) * 100 + o.o_custkey % 60 AS varchar), 4, '0') END AS dep_time,
    cast(floor(date_diff('day', cast(o.o_orderdate AS date), cast(s.fs AS date)) / 8.0) AS double) AS arr_delay,
    cast(floor(date_diff('day', cast(o.o_orderdate AS date), cast(s.ls AS date)) / 16.0) AS double) AS dep_delay,
    cast(s.sq AS double) AS crs_elapsed_time,
    s.mxd AS o_prcp, s.mxq AS o_wspd, s.mnt AS d_prcp, s.mnq AS d_wspd,
    cast(month(o.o_orderdate) AS int) AS month,
    cast(isodow(o.o_orderdate) AS int) AS day_of_week,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
         ELSE cast(20 + (n.n_nationkey * 7) % 35 AS double) END AS o_latitude,
    cast(-130 + (n.n_nationkey * 11) % 65 AS double) AS o_longitude,
    cast(20 + (((o.o_orderkey * 7 + o.o_custkey) % 25) * 7) % 35 AS double) AS d_latitude,
    cast(-130 + (((o.o_orderkey * 7 + o.o_custkey) % 25) * 11) % 65 AS double) AS d_longitude,
    cast((o.o_orderkey + n.n_nationkey) % 41 - 5 AS double) AS o_temp,
    cast((o.o_orderkey + (o.o_orderkey * 7 + o.o_custkey) % 25) % 37 - 3 AS double) AS d_temp
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN ship s ON s.l_orderkey = o.o_orderkey)
"""
