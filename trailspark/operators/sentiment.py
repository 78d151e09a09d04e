"""T16 sentiment: multinomial naive Bayes over the terms of whole texts,
trained and applied as DataFrame jobs (the same aggregation as T5), and the
arg-max of a score vector (X17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import blank_to_null, word_terms
from trailspark.operators.language import detect, train_profile


def argmax(scores) -> Column:
    """Position (from 0) of the first maximum of an array; null for a null or empty one."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(profile, classes)`` of the labelled texts; null labels and texts teach nothing."""
    rows = labelled.where(F.col(text_col).isNotNull())
    return train_profile(rows, text_col, label_col, word_terms)


def score(df: DataFrame, model: tuple[DataFrame, DataFrame], id_col: str = "journal_id", text_col: str = "journal_story",
          out: str = "sentiment") -> DataFrame:
    """Adds ``out`` (int class); null and blank stories are not scored and stay
    null, and the story comes back as '' where it is null (P7).  A story
    without any term is not scored either."""
    stories = df.select(id_col, blank_to_null(F.col(text_col)).alias("_t")).where(F.col("_t").isNotNull())
    best = detect(stories, *model, id_col=id_col, text_col="_t", grams=word_terms).select(
        id_col, F.col("lang_pred").cast("int").alias(out))
    return df.join(best, id_col, "left").withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
