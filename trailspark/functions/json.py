"""Weather-payload JSON schema and helpers (``from_json``, never Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEATHER_ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("main", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("icon", T.StringType()),
])

OBSERVATION = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("sunrise", T.LongType()),
    T.StructField("sunset", T.LongType()),
    T.StructField("temp", T.DoubleType()),
    T.StructField("feels_like", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("dew_point", T.DoubleType()),
    T.StructField("uvi", T.DoubleType()),
    T.StructField("clouds", T.DoubleType()),
    T.StructField("visibility", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("wind_deg", T.DoubleType()),
    T.StructField("wind_gust", T.DoubleType()),
    T.StructField("weather", T.ArrayType(WEATHER_ITEM)),
])

WEATHER_PAYLOAD = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("timezone_offset", T.LongType()),
    T.StructField("data", T.ArrayType(OBSERVATION)),
])


def has_key(payload, key: str) -> Column:
    """True when the top-level JSON object has ``key``, whatever its value (null included)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.array_contains(F.json_object_keys(p), key)
