"""Property tests: share sums to one, top-n bounds, the
range join keeps one row per input, matched + unmatched partition the
posts, and token cleaning is idempotent."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailspark.operators import cleaning as C
from trailspark.operators import geo as G
from trailspark.operators import reports as R

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows_st = st.lists(st.tuples(st.sampled_from(["L1", "L2", "L3", None]), st.integers(-1, 6)), min_size=1, max_size=40)


@SETTINGS
@given(rows=rows_st)
def test_share_sums_to_one_and_topn_bounded(spark, rows):
    df = spark.createDataFrame([(i, loc, t, f"w{t}") for i, (loc, t) in enumerate(rows)],
                               "journal_id long, location_name string, topic int, topic_words string")
    sums = R.topic_share(df).groupBy("location_name").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)
    assert all(r["c"] <= 5 for r in R.top_share_padded(df).groupBy("location_name").count()
               .withColumnRenamed("count", "c").collect())
    words = R.top_topics_words(df).collect()
    assert all(len(r["top_topics"].split(", ")) <= 3 for r in words)


lat_st = st.lists(st.one_of(st.floats(-5, 60, allow_nan=False).map(lambda x: f"{x:.3f}"),
                            st.sampled_from(["abc", "", None, "nan"])), min_size=1, max_size=30)
club_st = st.lists(st.tuples(st.floats(-5, 60, allow_nan=False), st.floats(-5, 60, allow_nan=False)),
                   min_size=1, max_size=6)


@SETTINGS
@given(lats=lat_st, ranges=club_st)
def test_range_join_one_row_per_input(spark, lats, ranges):
    locs = spark.createDataFrame([(i, v) for i, v in enumerate(lats)], "id int, latitude string")
    clubs = spark.createDataFrame([(f"C{i}", i, a, b) for i, (a, b) in enumerate(ranges)],
                                  "trail_club string, club_order int, lat_start double, lat_end double")
    out = {r["id"]: r["trail_club"] for r in G.assign_clubs(locs, clubs).collect()}
    assert sorted(out) == list(range(len(lats)))
    for i, v in enumerate(lats):     # brute force: first club in order whose range covers the value
        try:
            x = float(v)
        except (TypeError, ValueError):
            x = None
        want = ""
        if x is not None and x == x:
            for j, (a, b) in enumerate(ranges):
                if a <= x <= b:
                    want = f"C{j}"
                    break
        assert out[i] == want


@SETTINGS
@given(lats=lat_st, shel=st.lists(st.floats(-5, 60, allow_nan=False).map(lambda x: f"{x:.2f}"), max_size=8))
def test_matched_and_unmatched_partition_posts(spark, lats, shel):
    posts = spark.createDataFrame([(i, f"h{i}", v) for i, v in enumerate(lats)],
                                  "post_id long, trail_name string, latitude string")
    shelters = spark.createDataFrame([(f"S{i}", v) for i, v in enumerate(shel)] or [("S", "999")],
                                     "shelter_name string, latitude string")
    matched = {r["post_id"] for r in G.attach_shelters(posts, shelters, 2, how="inner").collect()}
    unmatched = {r["post_id"] for r in G.unmatched_posts(posts, shelters, 2).collect()}
    valid = {r["post_id"] for r in G.clean_latitude(posts).collect()}
    assert matched.isdisjoint(unmatched) and matched | unmatched == valid


words_st = st.lists(st.sampled_from(["Trail", "trail,", "the", "Bob", "bob", "bear", "a", "tent"]), max_size=12)


@SETTINGS
@given(stories=st.lists(st.one_of(words_st.map(" ".join), st.just(None)), min_size=1, max_size=6))
def test_clean_tokens_idempotent(spark, stories):
    j = spark.createDataFrame([(i, "Bob", s) for i, s in enumerate(stories)],
                              "journal_id long, trail_name string, journal_story string")
    stop = C.stop_list(j, spark.createDataFrame([("the",), ("a",)], "word string"))
    vocab = spark.createDataFrame([("trail",), ("bear",), ("tent",), ("bob",), ("the",)], "word string")
    once = C.clean_tokens(j, stop, vocab)
    twice = C.clean_tokens(once, stop, vocab)
    a = sorted((r["journal_id"], r["journal_story"]) for r in once.collect())
    b = sorted((r["journal_id"], r["journal_story"]) for r in twice.collect())
    assert a == b


@SETTINGS
@given(pts=st.lists(st.tuples(st.one_of(st.dates(min_value=__import__("datetime").date(2016, 1, 1),
                                                  max_value=__import__("datetime").date(2016, 4, 30)), st.none()),
                              st.one_of(st.integers(0, 4), st.none())), min_size=1, max_size=30))
def test_weekly_mean_matches_pandas_resample(spark, pts):
    import pandas as pd

    from trailspark.operators.timeseries import weekly_mean
    df = spark.createDataFrame(pts, "d date, sentiment int")
    got = {r["week_end"]: r["avg_sentiment"] for r in weekly_mean(df, "d", "sentiment").collect()}
    pdf = pd.DataFrame(pts, columns=["d", "sentiment"]).dropna(subset=["d"])
    if pdf.empty:
        assert got == {}
        return
    pdf["d"] = pd.to_datetime(pdf["d"])
    want = pdf.set_index("d")["sentiment"].astype("float").resample("W").mean()
    want = {k.date(): (None if pd.isna(v) else v) for k, v in want.items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k] is None and v is None) or abs(got[k] - v) < 1e-9


date_text_st = st.builds(
    lambda m, sp1, d, sp2, w, lead, trail: f"{lead}{m}{sp1}{d},{sp2}{w}{trail}",
    st.sampled_from(["Jan", "feb", "MAR", "Apr", "Sep", "Sept", "Dec", "zzz"]),
    st.sampled_from([" ", "  ", "\t", ""]),
    st.sampled_from(["1", "01", "5", "09", "10", "28", "29", "30", "31", "32", "00", "123"]),
    st.sampled_from([" ", "", "  "]),
    st.sampled_from(["Sat", "sun", "MON", "Xyz", "Saturday"]),
    st.sampled_from(["", " "]),
    st.sampled_from(["", " "]))


@SETTINGS
@given(texts=st.lists(date_text_st, min_size=1, max_size=20))
def test_date_parse_matches_python_strptime(spark, texts):
    import datetime as dt

    from trailspark.functions.dates import parse_month_day

    def ref(s):        # the reference's conversion, year 1900 first (so Feb 29 fails)
        try:
            return dt.datetime.strptime(s, "%b %d, %a").replace(year=2016).date()
        except ValueError:
            return None
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_month_day("s", strict_leap=True)).collect()]
    assert got == [ref(t) for t in texts]


num_text_st = st.one_of(
    st.floats(allow_nan=True, allow_infinity=True).map(repr),
    st.integers(-10**6, 10**6).map(str),
    st.sampled_from([" 35.5 ", "\t-1\n", "+3", "-.5", "5.", "1e5", "1E-3", "abc", "", "nan", "-inf", "Infinity",
                     "35.5d", "1f", "0x10", "1.2.3", "--1", "e5", ". 5", "3 5"]))


@SETTINGS
@given(texts=st.lists(num_text_st, min_size=1, max_size=25))
def test_lenient_double_matches_python_float(spark, texts):
    import math

    from trailspark.functions.geo import lenient_double

    def ref(v):
        try:
            return float(str(v).strip())
        except ValueError:
            return None
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(lenient_double("s")).collect()]
    for t, g in zip(texts, got):
        w = ref(t)
        if w is None or g is None:
            assert w is None and g is None, t
        elif math.isnan(w):
            assert math.isnan(g), t
        else:
            assert g == w, t


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(st.one_of(st.floats(-90, 90, allow_nan=False),
                             st.integers(-90000, 90000).map(lambda i: i / 1000),
                             st.sampled_from([-73.105, -49.825, 56.005, 14.235, 0.125, 2.675, 1.005, 0.135])),
                   min_size=1, max_size=200))
def test_round_half_even_matches_python_round(spark, xs):
    from trailspark.functions.geo import round_half_even, rounded_key
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(round_half_even("x", 2).alias("r"), rounded_key("x", 2).alias("k")).collect()
    for x, r in zip(xs, got):
        assert r["r"] == round(x, 2), x
        assert r["k"] == round(round(x, 2) * 100), x


story_words = st.sampled_from(["Trail", "trail,", "the", "The", "Bob", "bob", "Bobby", "bear", "a", "tent", "hut",
                               "then", " ", "x\ty"])


@SETTINGS
@given(stories=st.lists(st.one_of(st.lists(story_words, max_size=10).map(" ".join), st.just(None), st.just("   ")),
                        min_size=1, max_size=6))
def test_cleaning_matches_python_reference(spark, stories):
    names = ["Bob", "Al"]
    extras = ["the", "then", "a"]
    vocab = {"trail", "bear", "tent", "bob", "the", "hut"}
    stop_all = names + extras

    def py_tokens(text):        # keep token iff lower not in stop list and lower in vocabulary
        if not isinstance(text, str):
            return text
        out = " ".join(w for w in text.split() if w.lower() not in stop_all and w.lower() in vocab).strip()
        return out or None

    def py_substring(text):     # sequential replace, then strip; blank -> None
        if not isinstance(text, str):
            return text
        for w in stop_all:
            text = text.replace(w, "")
        return text.strip() or None

    rows = [(i, names[i % 2], s) for i, s in enumerate(stories)]
    j = spark.createDataFrame(rows, "journal_id long, trail_name string, journal_story string")
    # names in first-appearance order: Bob (id 0), Al (id 1); then the extras in their given order
    ex = spark.createDataFrame([(w, i) for i, w in enumerate(extras)], "word string, ord int")
    stop = C.stop_list(j if len(rows) > 1 else j.union(spark.createDataFrame([(99, "Al", None)], j.schema)), ex)
    voc = spark.createDataFrame([(w,) for w in sorted(vocab)], "word string")
    tok = dict((r["journal_id"], r["journal_story"]) for r in C.clean_tokens(j, stop, voc).collect())
    sub = dict((r["journal_id"], r["journal_story"]) for r in C.clean_substring(j, stop).collect())
    for i, s in enumerate(stories):
        assert tok[i] == py_tokens(s), s
        assert sub[i] == py_substring(s), s
