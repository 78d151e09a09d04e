import os
import tempfile

from pyspark.sql import functions as F

from trailspark.operators.timeseries import weekly_mean
from trailspark.streaming.weekly import start_weekly

EVENTS = "/root/testdata/sf0.001"


def test_weekly_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="ev-")
    ev = spark.read.parquet(f"{EVENTS}/events.parquet").select("ts", "value")
    ev.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "events"))
    ckpt = os.path.join(spark.conf.get("spark.checkpoint.dir"), "stream-test-" + os.path.basename(src))
    q = start_weekly(spark, os.path.join(src, "events"), ckpt, "weekly_test", "complete")
    try:
        q.processAllAvailable()
        got = {r["week_end"]: round(r["avg_sentiment"], 9) for r in spark.table("weekly_test").collect()}
    finally:
        q.stop()
    batch = weekly_mean(ev, "ts", "value").where(F.col("avg_sentiment").isNotNull())
    want = {r["week_end"]: round(r["avg_sentiment"], 9) for r in batch.collect()}
    assert got == want
