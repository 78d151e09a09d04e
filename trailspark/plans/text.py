"""Registered cleaning queries (T1-T4, F8) over the journals view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import cleaning as C
from trailspark.sources import tables as S


def _inputs(spark, sf_dir, version):
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story", "trail_name"])
    extras = S.stop_words(spark, sf_dir).where(F.col("version") == version).select("word")
    return j, C.stop_list(j, extras)


def stop_list(spark, sf_dir):
    """T4: names in first-appearance order, then version-1 extra words."""
    return _inputs(spark, sf_dir, 1)[1]


def clean_substring(spark, sf_dir):
    """Names + version-2 extras removed as substrings."""
    j, stop = _inputs(spark, sf_dir, 2)
    return C.clean_substring(j, stop).select("journal_id", "journal_story")


def clean_dict_substring(spark, sf_dir):
    """Vocabulary tokens kept, then names + version-2 extras removed."""
    j, stop = _inputs(spark, sf_dir, 2)
    return C.clean_dict_substring(j, stop, S.english_vocabulary(spark, sf_dir)).select("journal_id", "journal_story")


def clean_tokens(spark, sf_dir):
    """Tokens kept when in the vocabulary and not in the version-1 stop list."""
    j, stop = _inputs(spark, sf_dir, 1)
    return C.clean_tokens(j, stop, S.english_vocabulary(spark, sf_dir)).select("journal_id", "journal_story")


def clean_keep_raw(spark, sf_dir):
    """The T3-cleaned story beside the raw one."""
    j, stop = _inputs(spark, sf_dir, 1)
    kept = C.clean_tokens(C.keep_raw(j), stop, S.english_vocabulary(spark, sf_dir))
    return kept.select("journal_id", "journal_story", "journal_story_raw")


def valid_story_mask(spark, sf_dir):
    """F8: story has a token outside the version-1 stop list (lowercased)."""
    j, stop = _inputs(spark, sf_dir, 1)
    return C.valid_story_mask(j, stop).select("journal_id", "valid")
