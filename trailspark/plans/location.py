"""Registered location / club / emotion report queries over the journals view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.operators import reports as R
from trailspark.sources.tables import journals

REPORT_COLS = ["journal_id", "journal_story", "trail_club", "location_name", "latitude", "longitude",
               "topic", "topic_words"]


def _located(spark: SparkSession, sf_dir: str, with_label: bool = False) -> DataFrame:
    cols = REPORT_COLS + (["label"] if with_label else [])
    return R.exclude_no_club(journals(spark, sf_dir, with_label=with_label, columns=cols))


def location_top3_words(spark, sf_dir):
    """Q2 (flagship): top-3 topic words per location."""
    return R.top_topics_words(_located(spark, sf_dir), "location_name", 3)


def location_topic_share(spark, sf_dir):
    """Share of each topic per location."""
    return R.topic_share(_located(spark, sf_dir), "location_name")


def location_top5_padded(spark, sf_dir):
    """Top-5 topics per location by share, zero-padded."""
    return R.top_share_padded(_located(spark, sf_dir), "location_name", 5)


def location_top3_entries(spark, sf_dir):
    """Q3: top-3 topics per location with all their entries (long form)."""
    return R.top_topics_entries_long(_located(spark, sf_dir), 3)


def location_entries_wide(spark, sf_dir):
    """Q4: story-level top groups with number of journals and entry columns."""
    return R.top_story_groups(_located(spark, sf_dir), 3, 5)


def location_top3_entries_by_label(spark, sf_dir):
    """Q3 per label (the reference writes one table per label)."""
    return R.top_topics_entries_long(_located(spark, sf_dir, True), 3, by=["label"])


def location_entries_wide_by_label(spark, sf_dir):
    """Q4 per label."""
    return R.top_story_groups(_located(spark, sf_dir, True), 3, 5, by=["label"])


def location_first_n(spark, sf_dir):
    """Q5: first-n topic words and entries per (label, location, lat, lon)."""
    return R.first_n_lists(_located(spark, sf_dir, True), 3, 5, group_extra=["label"])


def coordinate_top3_entries(spark, sf_dir):
    """Q6: per (label, lat, lon) the top-3 topics with 5 entries each."""
    j = journals(spark, sf_dir, with_label=True, columns=REPORT_COLS + ["label"])
    return R.coordinate_top_entries(j, 3, 5, group=["label"])


def emotion_location_summary(spark, sf_dir):
    """Q7: emotion x location summary on the given topic column."""
    j = journals(spark, sf_dir, with_label=True, columns=REPORT_COLS + ["label"])
    return R.emotion_location_summary(j)


def few_topics_report(spark, sf_dir):
    """locations with fewer than 5 distinct topics."""
    return R.few_topics(_located(spark, sf_dir), "location_name", 5)


def club_topic_freq(spark, sf_dir):
    """Q8: topic frequency by club."""
    j = journals(spark, sf_dir, with_label=False, columns=["trail_club", "topic"])
    return R.club_topic_frequency(j, "trail_club")


def club_dominant_topic(spark, sf_dir):
    """Q9: dominant topic per club against its overall count (majority flag)."""
    j = journals(spark, sf_dir, with_label=False, columns=["trail_club", "topic"])
    return R.club_dominant_topic(j, "trail_club", threshold="majority")


def club_above_average(spark, sf_dir):
    """Q10: topics more frequent in a club than their mean share."""
    j = journals(spark, sf_dir, with_label=False, columns=["trail_club", "topic"])
    return R.above_average_topics(j, "trail_club")


def club_above_average_lists(spark, sf_dir):
    """Q10 list form per club."""
    j = journals(spark, sf_dir, with_label=False, columns=["trail_club", "topic"])
    return R.above_average_lists(j, "trail_club")


def topic_chart_rows(spark, sf_dir):
    """Q10 chart data: above-average topics per club with their words."""
    j = journals(spark, sf_dir, with_label=False, columns=["trail_club", "topic", "topic_words"])
    hits = R.above_average_topics(j, "trail_club")
    ranked = hits.withColumn("rank", F.col("topic"))
    words = j.groupBy("topic").agg(F.min("topic_words").alias("topic_words"))
    return R.topic_chart_rows(ranked, "trail_club", words)


def small_groups_report(spark, sf_dir):
    """F9 complement: (label, location) groups skipped for having < 2 entries."""
    j = journals(spark, sf_dir, with_label=True, columns=["journal_id", "label", "location_name"])
    return R.small_groups(j, ["label", "location_name"], 2)


def location_chart_rows(spark, sf_dir):
    """Q1 chart data: per location the top-5 (padded) topics as 'Topic t: words' lines."""
    loc = _located(spark, sf_dir)
    ranked = R.top_share_padded(loc, "location_name", 5)
    words = loc.groupBy("topic").agg(F.min("topic_words").alias("topic_words"))
    return R.topic_chart_rows(ranked, "location_name", words)
