"""Journal date parsing (X13) and the weekly mean with empty weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.dates import parse_month_day, week_end_sunday


def parse_dates(df: DataFrame, col: str = "date_text", out: str = "date", **kw) -> DataFrame:
    """Add the parsed date (null when the text does not parse)."""
    return df.withColumn(out, parse_month_day(col, **kw))


def date_rejects(df: DataFrame, col: str = "date_text", **kw) -> DataFrame:
    """Report of non-null texts that fail to parse ('Problem with date')."""
    return df.where(F.col(col).isNotNull() & parse_month_day(col, **kw).isNull())


def weekly_mean(df: DataFrame, date_col: str, value_col: str, out: str = "avg_sentiment") -> DataFrame:
    """Mean per Monday..Sunday week labelled by its Sunday (``week_end``).

    Rows with a null date are dropped; null values are ignored by the mean;
    every week between the first and the last is emitted, empty weeks with
    a null mean.  The aggregation is partial (map-side), and the calendar of
    weeks is generated from one min/max row, so no step holds the data.
    """
    d = (df.where(F.col(date_col).isNotNull())
         .select(week_end_sunday(F.to_date(F.col(date_col))).alias("week_end"), F.col(value_col).alias("_v")))
    agg = d.groupBy("week_end").agg(F.avg("_v").alias(out))
    cal = agg.agg(F.min("week_end").alias("a"), F.max("week_end").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    return cal.join(agg, "week_end", "left")
