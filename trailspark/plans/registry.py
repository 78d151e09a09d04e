"""Query registry: name -> callable(spark, sf_dir) and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailspark.plans import files, location, prep, text, topics
from trailspark.plans.oracle import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "location_top3_words": location.location_top3_words,
    "location_topic_share": location.location_topic_share,
    "location_top5_padded": location.location_top5_padded,
    "few_topics_report": location.few_topics_report,
    "small_groups_report": location.small_groups_report,
    "location_chart_rows": location.location_chart_rows,
    "location_top3_entries": location.location_top3_entries,
    "location_entries_wide": location.location_entries_wide,
    "location_top3_entries_by_label": location.location_top3_entries_by_label,
    "location_entries_wide_by_label": location.location_entries_wide_by_label,
    "location_first_n": location.location_first_n,
    "coordinate_top3_entries": location.coordinate_top3_entries,
    "emotion_location_summary": location.emotion_location_summary,
    "club_topic_freq": location.club_topic_freq,
    "club_dominant_topic": location.club_dominant_topic,
    "club_above_average": location.club_above_average,
    "club_above_average_lists": location.club_above_average_lists,
    "topic_chart_rows": location.topic_chart_rows,
    "scan_filter_no_club": prep.scan_filter_no_club,
    "filter_latitude_sentinel": prep.filter_latitude_sentinel,
    "drop_missing_any": prep.drop_missing_any,
    "state_not_null": prep.state_not_null,
    "crop_first_n": prep.crop_first_n,
    "split_label_counts": prep.split_label_counts,
    "combine_by_name": prep.combine_by_name_q,
    "shelter_match": prep.shelter_match,
    "shelter_unmatched": prep.shelter_unmatched,
    "club_first_match": prep.club_first_match,
    "club_unassigned": prep.club_unassigned,
    "club_fill": prep.club_fill,
    "attribution_chain": prep.attribution_chain,
    "year_dated_rows": prep.year_dated_rows,
    "date_parse_rejects": prep.date_parse_rejects,
    "journal_dates": prep.journal_dates,
    "journal_dates_strict": prep.journal_dates_strict,
    "weekly_sentiment": prep.weekly_sentiment,
    "stop_list": text.stop_list,
    "clean_substring": text.clean_substring,
    "clean_dict_substring": text.clean_dict_substring,
    "clean_tokens": text.clean_tokens,
    "valid_story_mask": text.valid_story_mask,
    "missing_values_report": prep.missing_values_report,
    "json_required_key": prep.json_required_key,
    "json_flatten": prep.json_flatten,
    "json_nested_flatten": prep.json_nested_flatten,
    "term_counts": topics.term_counts,
    "term_counts_bigrams": topics.term_counts_bigrams,
    "topic_words_ctfidf": topics.topic_words_ctfidf,
    "topic_bar": topics.topic_bar,
    "topic_similarity": topics.topic_similarity,
    "detect_language": topics.detect_language,
    "topic_fit": topics.topic_fit,
    "topic_target_search": topics.topic_target_search,
    "topic_reduce": topics.topic_reduce,
    "topic_reduce_auto": topics.topic_reduce_auto,
    "topic_hierarchy": topics.topic_hierarchy,
    "topic_hierarchy_given": topics.topic_hierarchy_given,
    "topic_reduce_given": topics.topic_reduce_given,
    "topic_per_group_vectors": topics.topic_per_group_vectors,
    "emotion_location_vectors": topics.emotion_location_vectors,
    "topic_label_given": topics.topic_label_given,
    "topic_per_group_given": topics.topic_per_group_given,
    "topic_group_skipped": topics.topic_group_skipped,
    "topic_assign": topics.topic_assign,
    "topic_assign_english": topics.topic_assign_english,
    "emotion_location_topics": topics.emotion_location_topics,
    "topic_per_group": topics.topic_per_group,
    "sentiment_score": topics.sentiment_score,
    "sentiment_weekly": topics.sentiment_weekly,
    "clean_keep_raw": text.clean_keep_raw,
    "shelter_match_2dp": prep.shelter_match_2dp,
    "topic_assign_given": topics.topic_assign_given,
    "valid_english_story": topics.valid_english_story,
    "topic_density_given": topics.topic_density_given,
    **files.QUERIES,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
