"""Schema of the raw flight-and-weather table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the raw CSV.
FLIGHT_SCHEMA = T.StructType([
    T.StructField("FL_DATE", T.StringType()),
    T.StructField("OP_CARRIER", T.StringType()),
    T.StructField("OP_CARRIER_FL_NUM", T.IntegerType()),
    T.StructField("ORIGIN", T.StringType()),
    T.StructField("DEST", T.StringType()),
    T.StructField("CRS_DEP_TIME", T.StringType()),
    T.StructField("DEP_TIME", T.StringType()),
    T.StructField("DEP_DELAY", T.FloatType()),
    T.StructField("TAXI_OUT", T.FloatType()),
    T.StructField("WHEELS_OFF", T.StringType()),
    T.StructField("WHEELS_ON", T.StringType()),
    T.StructField("TAXI_IN", T.FloatType()),
    T.StructField("CRS_ARR_TIME", T.StringType()),
    T.StructField("ARR_TIME", T.StringType()),
    T.StructField("ARR_DELAY", T.FloatType()),
    T.StructField("CRS_ELAPSED_TIME", T.FloatType()),
    T.StructField("ACTUAL_ELAPSED_TIME", T.FloatType()),
    T.StructField("AIR_TIME", T.FloatType()),
    T.StructField("FLIGHTS", T.IntegerType()),
    T.StructField("MONTH", T.IntegerType()),
    T.StructField("DAY_OF_MONTH", T.IntegerType()),
    T.StructField("DAY_OF_WEEK", T.IntegerType()),
    T.StructField("ORIGIN_INDEX", T.IntegerType()),
    T.StructField("DEST_INDEX", T.IntegerType()),
    T.StructField("O_TEMP", T.FloatType()),
    T.StructField("O_PRCP", T.FloatType()),
    T.StructField("O_WSPD", T.FloatType()),
    T.StructField("D_TEMP", T.FloatType()),
    T.StructField("D_PRCP", T.FloatType()),
    T.StructField("D_WSPD", T.FloatType()),
    T.StructField("O_LATITUDE", T.FloatType()),
    T.StructField("O_LONGITUDE", T.FloatType()),
    T.StructField("D_LATITUDE", T.FloatType()),
    T.StructField("D_LONGITUDE", T.FloatType()),
])

# Texts read as null, the loader's own and those a CSV reader takes by default.
NULL_TOKENS = (
    "", "NA", "null", "\\N", "NaN", "nan",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NULL", "None", "n/a",
)

# A row without one of these is not a flight.
ESSENTIAL = ("ORIGIN", "DEST", "OP_CARRIER", "FL_DATE")
