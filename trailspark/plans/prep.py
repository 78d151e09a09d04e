"""Registered ingest / prep / geo / time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import geo as G
from trailspark.operators import reports as R
from trailspark.operators import timeseries as TS
from trailspark.sources import tables as S
from trailspark.sources.files import combine_by_name


def scan_filter_no_club(spark, sf_dir):
    """drop 'No Club', keep null clubs."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_club", "location_name"])
    return R.exclude_no_club(j)


def filter_latitude_sentinel(spark, sf_dir):
    """drop latitude -1, keep nulls."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "latitude", "longitude"])
    return R.exclude_latitude_sentinel(j)


def drop_missing_any(spark, sf_dir):
    """drop rows where any of location, club or label is null."""
    j = S.journals(spark, sf_dir, with_label=True,
                   columns=["journal_id", "location_name", "trail_club", "label"])
    return j.dropna(how="any", subset=["location_name", "trail_club", "label"])


def state_not_null(spark, sf_dir):
    """Drop rows without a state."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "state"])
    return j.where(F.col("state").isNotNull())


def crop_first_n(spark, sf_dir, n: int = 500):
    """Q17/L2: the first ``n`` rows in journal order (the limit is the feature)."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_name", "location_name"])
    return j.orderBy("journal_id").limit(n)


def split_label_counts(spark, sf_dir):
    """Q19/K7: rows per label value (null labels are not written)."""
    j = S.journals(spark, sf_dir, with_label=True, columns=["journal_id", "label"])
    return j.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def combine_by_name_q(spark, sf_dir):
    """Union of two tables with different columns and order."""
    a = S.read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))
    b = S.read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"]).select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"),
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return combine_by_name([a, b])


def shelter_match(spark, sf_dir):
    """Q12/J1+J3: posts with their shelter by rounded position (matched only)."""
    return G.attach_shelters(S.posts(spark, sf_dir), S.shelters(spark, sf_dir), decimals=0, how="inner")


def shelter_match_2dp(spark, sf_dir):
    """Q12/J1 at two decimals: posts whose position rounds to a shelter's
    (positions divided by 700, so that they have many decimals and meet)."""
    near = lambda df: df.withColumn("latitude", F.col("latitude").cast("double") / 700)
    return G.attach_shelters(near(S.posts(spark, sf_dir)), near(S.shelters(spark, sf_dir)), decimals=2, how="inner")


def shelter_unmatched(spark, sf_dir):
    """Posts without a shelter (trail name, latitude)."""
    return G.unmatched_posts(S.posts(spark, sf_dir), S.shelters(spark, sf_dir), decimals=0).select(
        "trail_name", "latitude")


def club_first_match(spark, sf_dir):
    """Club of every post by range, first club wins, '' when none."""
    return G.assign_clubs(S.posts(spark, sf_dir), S.clubs(spark, sf_dir))


def club_unassigned(spark, sf_dir):
    """Posts with a valid position and no club."""
    return G.unassigned_latitudes(S.posts(spark, sf_dir), S.clubs(spark, sf_dir))


def club_fill(spark, sf_dir):
    """Q14/P5: unassigned clubs become 'No Club'."""
    return G.fill_no_club(G.assign_clubs(S.posts(spark, sf_dir), S.clubs(spark, sf_dir)))


def attribution_chain(spark, sf_dir):
    """Q12 -> Q13 -> Q14 -> F1 as one plan: shelter and club of every post
    with a position, blank clubs filled, posts without a club left out."""
    located = G.attach_shelters(S.posts(spark, sf_dir), S.shelters(spark, sf_dir), decimals=0, how="left")
    filled = G.fill_no_club(G.assign_clubs(located, S.clubs(spark, sf_dir)))
    return filled.where(F.col("trail_club") != G.NO_CLUB).select("post_id", "trail_name", "latitude", "location_name", "trail_club")


def year_dated_rows(spark, sf_dir):
    """Date text with its year appended (the year a file name would carry)."""
    o = S.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"])
    o = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("latitude"),
                 F.col("o_custkey").cast("double").alias("longitude"),
                 F.date_format("o_orderdate", "MMM dd, EEE").alias("date_text"),
                 F.year("o_orderdate").cast("string").alias("year"))
    o = o.dropna(how="any", subset=["latitude", "longitude"])
    return o.withColumn("date_text", F.concat(F.col("date_text"), F.lit(", "), F.col("year")))


def date_parse_rejects(spark, sf_dir):
    """X13 report: journal dates that do not parse."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "date_text"])
    return TS.date_rejects(j)


def journal_dates(spark, sf_dir):
    """Parsed journal dates (year 2016)."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "date_text"])
    return TS.parse_dates(j)


def journal_dates_strict(spark, sf_dir):
    """X13 as the reference parses: Feb 29 is rejected."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "date_text"])
    return TS.parse_dates(j, strict_leap=True)


def weekly_sentiment(spark, sf_dir):
    """Weekly mean of the event value, empty weeks kept as null."""
    e = S.read_table(spark, sf_dir, "events", ["ts", "value"])
    return TS.weekly_mean(e, "ts", "value")


def json_required_key(spark, sf_dir):
    """Does each event payload hold the key 'k'?"""
    from trailspark.operators.payload import payload_valid
    e = S.read_table(spark, sf_dir, "events", ["event_id", "props"])
    return payload_valid(e, "props", "k").select("event_id", "valid")


def json_flatten(spark, sf_dir):
    """Event payloads parsed into columns."""
    from trailspark.operators.payload import flatten_object
    e = S.read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    return flatten_object(e, "props", "k BIGINT", keep=["event_id", "event_type"])


def json_nested_flatten(spark, sf_dir):
    """Nested payloads (written as JSON from the events) flattened to one
    row per observation and weather item; every fifth payload lacks ``data``,
    every third has an empty weather list."""
    from trailspark.operators.payload import flatten_weather
    e = S.read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    weather = F.filter(F.array(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("main"))),
                       lambda _: F.col("event_id") % 3 != 0)
    data = F.array(F.struct(F.col("event_id").alias("dt"), F.col("value").alias("temp"), weather.alias("weather")))
    payload = F.struct(F.col("value").alias("lat"), F.col("user_id").cast("double").alias("lon"), F.col("event_type").alias("timezone"),
                       F.when(F.col("event_id") % 5 != 0, data).alias("data"))
    flat = flatten_weather(e.select("event_id", F.to_json(payload).alias("payload")), keep=["event_id"])
    return flat.select("event_id", "lat", "lon", "timezone", "dt", "temp", "weather_id", "weather_main")


def missing_values_report(spark, sf_dir):
    """null counts of the journal columns the reports depend on."""
    from trailspark.operators.quality import null_report
    cols = ["journal_story", "trail_club", "location_name", "label", "state", "date_text"]
    j = S.journals(spark, sf_dir, with_label=True, columns=cols)
    return null_report(j, cols)
