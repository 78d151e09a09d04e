"""Operator tests on small literal fixtures (edge rows of FIXTURES.md section 2)."""

import datetime as dt

from pyspark.sql import functions as F

from trailspark.functions.dates import parse_month_day
from trailspark.functions.geo import lenient_double, round_half_even, valid_coordinate
from trailspark.functions.text import blank_to_null, tokens
from trailspark.operators import cleaning as C
from trailspark.operators import geo as G
from trailspark.operators import reports as R
from trailspark.operators import timeseries as TS
from trailspark.operators.payload import flatten_weather, payload_valid
from trailspark.sources.files import combine_by_name


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sentinel_filters_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "No Club", -1.0), (3, "A", 35.5)],
                               "id long, trail_club string, latitude double")
    assert rows(R.exclude_no_club(df), "id") == [(1,), (3,)]
    assert rows(R.exclude_latitude_sentinel(df), "id") == [(1,), (3,)]


def test_blank_to_null_unicode_whitespace(spark):
    df = spark.createDataFrame([(1, ""), (2, "   "), (3, "\t\n"), (4, " "), (5, None), (6, " a  b ")],
                               "id int, s string")
    out = dict((r["id"], r["v"]) for r in df.select("id", blank_to_null("s").alias("v")).collect())
    assert out == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "a  b"}
    toks = dict((r["id"], r["t"]) for r in df.select("id", tokens("s").alias("t")).collect())
    assert toks[6] == ["a", "b"] and toks[4] == []


def test_lenient_double(spark):
    df = spark.createDataFrame([(" 35.5 ",), ("abc",), ("nan",), ("inf",), (None,), ("1_000",)], "s string")
    out = df.select(lenient_double("s").alias("x")).select(
        "x", valid_coordinate("x").alias("ok")).collect()
    assert out[0]["x"] == 35.5 and out[0]["ok"]
    assert out[1]["x"] is None
    assert not out[2]["ok"] and not out[3]["ok"]
    assert out[4]["x"] is None
    assert out[5]["x"] is None  # Python accepts 1_000; Spark does not (documented deviation)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,)], "x double")
    out = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert out[0] == 0.12
    assert [r[0] for r in df.select(round_half_even("x", 0)).collect()][2] == 2.0


def test_shelter_join(spark):
    posts = spark.createDataFrame([(1, "a", "35.121"), (2, "b", "36.0"), (3, "c", "abc"), (4, "d", "0.125")],
                                  "post_id long, trail_name string, latitude string")
    shelters = spark.createDataFrame([("S1", "35.12"), ("S2", "35.1249"), ("S3", "0.12")],
                                     "shelter_name string, latitude string")
    m = G.attach_shelters(posts, shelters, 2, how="left")
    got = rows(m, "post_id", "location_name")
    # two shelters on one rounded latitude multiply the post; 0.125 -> 0.12 (half-even)
    assert got == [(1, "S1"), (1, "S2"), (2, None), (4, "S3")]
    assert rows(G.unmatched_posts(posts, shelters, 2), "post_id") == [(2,)]


def test_club_range_first_match(spark):
    clubs = spark.createDataFrame(
        [("A", 0, 10.0, 20.0), ("B", 1, 15.0, 30.0), ("C", 2, 50.0, 40.0), ("D", 3, 60.0, 70.0)],
        "trail_club string, club_order int, lat_start double, lat_end double")
    locs = spark.createDataFrame([(1, "10"), (2, "20"), (3, "17"), (4, "25"), (5, "45"), (6, "35"), (7, "x"),
                                  (8, "30"), (9, "70")], "id int, latitude string")
    out = dict(rows(G.assign_clubs(locs, clubs), "id", "trail_club"))
    assert out == {1: "A", 2: "A", 3: "A", 4: "B", 5: "", 6: "", 7: "", 8: "B", 9: "D"}
    assert len(G.assign_clubs(locs, clubs).collect()) == 9  # exactly one row per input
    assert rows(G.unassigned_latitudes(locs, clubs), "id") == [(5,), (6,)]
    filled = dict(rows(G.fill_no_club(G.assign_clubs(locs, clubs)), "id", "trail_club"))
    assert filled[5] == "No Club" and filled[1] == "A"


def test_parse_month_day(spark):
    df = spark.createDataFrame([("Mar 05, Sat",), ("Mar 05, Mon",), ("Feb 29, Mon",), ("zzz 05, Sat",), (None,),
                                ("mar 5, sun",), ("Mar 05, Xyz",)], "s string")
    out = [r[0] for r in df.select(parse_month_day("s")).collect()]
    assert out == [dt.date(2016, 3, 5), dt.date(2016, 3, 5), dt.date(2016, 2, 29), None, None,
                   dt.date(2016, 3, 5), None]
    strict = [r[0] for r in df.select(parse_month_day("s", strict_leap=True)).collect()]
    assert strict[2] is None


def test_weekly_mean_gaps(spark):
    df = spark.createDataFrame(
        [(dt.date(2016, 3, 6), 4), (dt.date(2016, 3, 7), 2), (dt.date(2016, 3, 8), None), (dt.date(2016, 3, 13), 3),
         (dt.date(2016, 3, 28), 1), (None, 0)], "d date, sentiment int")
    out = rows(TS.weekly_mean(df, "d", "sentiment"), "week_end", "avg_sentiment")
    assert out == [(dt.date(2016, 3, 6), 4.0), (dt.date(2016, 3, 13), 2.5), (dt.date(2016, 3, 20), None),
                   (dt.date(2016, 3, 27), None), (dt.date(2016, 4, 3), 1.0)]


def test_top_topics_ties_and_nulls(spark):
    data = [(i, "L1", t, f"w{t}") for i, t in enumerate([1, 1, 2, 2, 3, 3, 4])] + \
           [(10, "L2", 5, "w5"), (11, None, 6, "w6")]
    df = spark.createDataFrame(data, "journal_id long, location_name string, topic int, topic_words string")
    out = dict(rows(R.top_topics_words(df), "location_name", "top_topics"))
    assert out == {"L1": "w1, w2, w3", "L2": "w5"}


def test_top_share_padded(spark):
    data = [(1, "L1", 3), (2, "L1", 3), (3, "L1", 7), (4, "L2", -1), (5, "L2", 0), (6, "L2", 1), (7, "L2", 2),
            (8, "L2", 3), (9, "L2", 7)]
    df = spark.createDataFrame(data, "journal_id long, location_name string, topic int")
    out = rows(R.top_share_padded(df).where("location_name = 'L1'"), "rank", "topic", "n")
    assert out == [(1, 3, 2), (2, 7, 1), (3, -1, 0), (4, 0, 0), (5, 1, 0)]
    assert R.top_share_padded(df).where("location_name = 'L2'").count() == 5


def test_clean_substring_and_tokens(spark):
    j = spark.createDataFrame(
        [(1, "Bob", "Bobby walked the trail, then Bob rested"), (2, "Al", "The Al the"), (3, "zed", None),
         (4, "x", "   ")],
        "journal_id long, trail_name string, journal_story string")
    extras = spark.createDataFrame([("the",), ("then",)], "word string")
    stop = C.stop_list(j, extras)
    # order: Bob (id 1), Al (id 2), zed (id 3), x (id 4), then extras sorted: the, then
    sub = dict(rows(C.clean_substring(j, stop), "journal_id", "journal_story"))
    assert sub[1] == "by walked  trail, n  rested"
    assert sub[2] == "The"
    assert sub[3] is None and sub[4] is None
    vocab = spark.createDataFrame([("walked",), ("trail",), ("rested",), ("the",), ("bob",), ("al",)], "word string")
    tok = dict(rows(C.clean_tokens(j, stop, vocab), "journal_id", "journal_story"))
    # 'trail,' fails the vocabulary; capitalised 'Bob' is not matched by the stop name 'Bob' after lower()
    assert tok[1] == "walked Bob rested"
    assert tok[2] == "Al"
    mask = dict(rows(C.valid_story_mask(j, stop), "journal_id", "valid"))
    assert mask == {1: True, 2: True, 3: False, 4: False}


def test_club_dominant_and_above_average(spark):
    data = [("A", 1)] * 3 + [("A", 2)] + [("B", 1)] + [("B", 2)] * 2 + [(None, 3), ("C", -1)]
    df = spark.createDataFrame(data, "trail_club string, topic int")
    dom = dict((r["trail_club"], (r["topic"], r["club_count"], r["overall_count"], r["uniquely_frequent"]))
               for r in R.club_dominant_topic(df, threshold="majority").collect())
    assert dom["A"] == (1, 3, 4, True) and dom["B"] == (2, 2, 3, True) and dom["C"] == (-1, 1, 1, True)
    lists = dict(rows(R.above_average_lists(df), "trail_club", "topics"))
    assert lists == {"A": [1], "B": [2], "C": [-1]}


def test_emotion_summary(spark):
    data = [(1, "joy", "L1", 1, "a b", "s1"), (2, "joy", "L1", 2, "c", "s2"), (3, "joy", "L2", 1, "a b", "s3"),
            (4, None, "L1", 1, "a b", "s4")]
    df = spark.createDataFrame(data, "journal_id long, label string, location_name string, topic int, "
                                     "topic_words string, journal_story string")
    out = R.emotion_location_summary(df).collect()
    assert len(out) == 1 and out[0]["location"] == "L1" and out[0]["number_of_journals"] == 2
    assert out[0]["topic_1_words"] == "c" and out[0]["journal_entry_2"] == "s2" and out[0]["journal_entry_3"] is None


def test_combine_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("y", 2.0)], "name string, score double")
    out = combine_by_name([a, b])
    assert set(out.columns) == {"id", "name", "score", "source_no"}
    assert rows(out, "name", "source_no") == [("x", 0), ("y", 1)]


def test_weather_payload(spark):
    p1 = ('{"lat": 1, "lon": 2, "timezone": "UTC", "timezone_offset": 0, "data": [{"dt": 1, "temp": 3.5, '
          '"weather": [{"id": 800, "main": "Clear", "description": "clear", "icon": "01d"}, '
          '{"id": 500, "main": "Rain", "description": "rain", "icon": "10d"}]}]}')
    p2 = '{"lat": 1, "lon": 2, "data": []}'
    df = spark.createDataFrame([(1, p1), (2, p2)], "id int, payload string")
    assert rows(payload_valid(df), "id", "valid") == [(1, True), (2, False)]
    flat = flatten_weather(df, keep=["id"])
    assert rows(flat, "id", "weather_main") == [(1, "Clear"), (1, "Rain"), (2, None)]


def test_week_buckets_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    q = E.queries()["weekly_sentiment"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect())
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ny and len(utc) >= 4


def test_substring_removal_in_batches(spark):
    """Words go one after another, also where removing one makes the next; every partition gets the list; the whole
    list is gone through inside the task, not by an expression per word and byte in the row."""
    words = ["ab", "cd", "é", "zz", "x\U0001f600", "", "aé"]
    stop = spark.createDataFrame([(w, 1, float(k)) for k, w in enumerate(words)], "word string, g int, k double")
    texts = ["acdb ab", "aabb xé cd", "azézb", "x\U0001f600\U0001f600", " zz ", "", None, "aaébc d", "ÉAB"] * 7
    j = spark.createDataFrame([(i, t, f"n{i}") for i, t in enumerate(texts)], "journal_id long, journal_story string, trail_name string").repartition(5)
    cleaned = C.clean_substring(j, stop)
    assert cleaned.columns == j.columns
    got = {r["journal_id"]: (r["journal_story"], r["trail_name"]) for r in cleaned.collect()}
    for i, t in enumerate(texts):
        for w in words if t else []:
            t = t.replace(w, "") if w else t
        assert got[i] == ((t or "").strip() or None, f"n{i}"), i
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "replace(" not in plan
