"""Q11 as Structured Streaming: weekly mean over an unbounded event source.

Event-time windows of 7 days starting on Mondays (1970-01-01 was a
Thursday, hence ``startTime='4 days'``), labelled by their Sunday.  A
watermark bounds the state: a week's partial mean is dropped once the
watermark passes its end plus the allowed lateness.  Unlike the batch
operator, a stream cannot emit empty weeks (no row ever arrives for them);
the batch :func:`trailspark.operators.timeseries.weekly_mean` fills them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_mean_stream(events: DataFrame, ts_col: str = "ts", value_col: str = "value",
                       lateness: str = "14 days", out: str = "avg_sentiment") -> DataFrame:
    ts = F.col(ts_col).cast("timestamp")
    return (events.withColumn("_ts", ts).withWatermark("_ts", lateness)
            .groupBy(F.window("_ts", "7 days", "7 days", "4 days").alias("w"))
            .agg(F.avg(value_col).alias(out), F.count(F.lit(1)).alias("rows"))
            .select(F.to_date(F.col("w.end") - F.expr("INTERVAL 1 DAY")).alias("week_end"), out, "rows"))


def read_events_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """File stream over a folder of event parquet files (schema from a static read)."""
    schema = spark.read.parquet(folder).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def start_weekly(spark: SparkSession, folder: str, checkpoint: str, query_name: str = "weekly_sentiment",
                 output_mode: str = "update"):
    """Start the streaming query into a memory table (for notebooks and
    tests); production runs would write to a table sink instead.
    ``checkpoint`` must be a shared, durable folder so a restarted driver
    resumes from the stored offsets and state."""
    q = (weekly_mean_stream(read_events_stream(spark, folder)).writeStream
         .outputMode(output_mode).format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint).start())
    return q
