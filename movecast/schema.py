"""Fixed row layouts."""

from pyspark.sql import types as T

POINT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),  # epoch milliseconds
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
    ]
)

FORECAST_COLUMNS = (
    "id",
    "timestamp",
    "longitude",
    "latitude",
    "speed",
    "heading",
    "error",
    "horizon",
    "step",
    "origin_timestamp",
    "segment",
    "variant",
    "config_id",
)

FORECAST = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("error", T.BooleanType()),
        T.StructField("horizon", T.IntegerType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("origin_timestamp", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("variant", T.StringType()),
        T.StructField("config_id", T.StringType()),
    ]
)

ACCURACY = T.StructType(
    [
        T.StructField("settings", T.StringType()),
        T.StructField("prediction_timestamp", T.LongType()),
        T.StructField("horizon", T.IntegerType()),
        T.StructField("dist_lon_lat", T.DoubleType()),
        T.StructField("altitude", T.DoubleType()),
    ]
)

#: Stored tables by kind: their columns, and those that are folders.
STORED = {"forecasts": (FORECAST, ("variant", "horizon")), "actuals": (T.StructType(POINT.fields[:4]), ())}
