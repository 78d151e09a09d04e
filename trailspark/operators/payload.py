"""Weather payload check and flattening (``from_json`` + ``explode``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.json import WEATHER_PAYLOAD, has_key


def payload_valid(df: DataFrame, col: str = "payload", key: str = "timezone") -> DataFrame:
    """Adds ``valid``: the payload is a JSON object holding ``key``."""
    return df.withColumn("valid", F.coalesce(has_key(col, key), F.lit(False)))


def flatten_weather(df: DataFrame, col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One row per (observation, weather item); payloads without ``data`` or
    with empty lists keep one row with nulls (``explode_outer``)."""
    keep = keep or []
    p = df.select(*keep, F.from_json(col, WEATHER_PAYLOAD).alias("p"))
    obs = p.select(*keep, "p.lat", "p.lon", "p.timezone", "p.timezone_offset",
                   F.explode_outer("p.data").alias("o"))
    items = obs.select(*keep, "lat", "lon", "timezone", "timezone_offset", "o.*")
    w = items.select("*", F.explode_outer("weather").alias("w")).drop("weather")
    return w.select("*", F.col("w.id").alias("weather_id"), F.col("w.main").alias("weather_main"),
                    F.col("w.description").alias("weather_description"),
                    F.col("w.icon").alias("weather_icon")).drop("w")


def flatten_object(df: DataFrame, col: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Parse a JSON object column with a DDL schema into top-level columns."""
    keep = keep or []
    return df.select(*keep, F.from_json(col, schema).alias("_j")).select(*keep, "_j.*")
