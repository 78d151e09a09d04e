"""Table scans over a folder of parquet files, and the canonical views.

``read_table`` is the one place that touches storage.  It always passes an
explicit column list so the parquet scan's ReadSchema carries only what the
query needs; filters added later by operators are pushed into the same scan
by Catalyst.

The driver's synthetic tables do not contain trail journals, so
``journals`` derives the canonical journal table from ``documents`` (and
``labels``) with integer arithmetic on ``doc_id``.  The same expressions are
written in SQL in :mod:`trailspark.plans.oracle` so both engines see the
same rows.  The lookups (shelters, clubs, stop words, vocabulary) are
likewise derived from the given tables so their size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.text import WORD_PATTERN

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------------------
# journals: canonical fact table (FIXTURES.md 1.1) derived from documents.

def _topic_expr(doc_id: Column) -> Column:
    # floor(id/50) mod (2 + (id mod 50) mod 8) - 1: contains -1 and gives each
    # location between 2 and 9 distinct topics.
    return ((F.floor(doc_id / 50) % (F.lit(2) + (doc_id % 50) % 8)) - 1).cast("int")


def topic_words_expr(topic: Column) -> Column:
    """Words of a report topic: 1 to 4 words ``w<topic>_<i>`` joined by ', '."""
    n = F.lit(1) + ((topic + 1) % 4)
    return F.array_join(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), topic.cast("string"), F.lit("_"), i.cast("string"))),
        ", ")


def journals(spark: SparkSession, sf_dir: str, with_label: bool = True,
             columns: list[str] | None = None) -> DataFrame:
    """Canonical ``journals`` table.

    ``with_label`` adds the emotion-like ``label`` from the ``labels`` table
    (left join on the document key; documents without a label get null).
    Queries that do not need the label skip the join entirely.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    d = F.col("doc_id")
    sentinel_lat = (d % 29) == 0
    out = docs.select(
        d.alias("journal_id"),
        F.col("text").alias("journal_story"),
        F.concat(F.lit("hiker"), (d % 37).cast("string")).alias("trail_name"),
        F.when(d % 23 == 0, F.lit(None).cast("string"))
         .when(d % 11 == 0, F.lit("No Club"))
         .otherwise(F.col("source")).alias("trail_club"),
        F.when(d % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("shelter"), (d % 50).cast("string"))).alias("location_name"),
        F.when(sentinel_lat, F.lit(-1.0)).otherwise(F.lit(34.0) + (d % 50) / 4.0).alias("latitude"),
        F.when(sentinel_lat, F.lit(-1.0)).otherwise(F.lit(-84.0) + (d % 50) / 4.0).alias("longitude"),
        F.when(d % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ST"), (d % 14).cast("string"))).alias("state"),
        F.when(d % 31 == 0, F.lit(None).cast("string"))
         .when(d % 43 == 0, F.lit("zzz 05, Sat"))
         .otherwise(F.date_format(F.date_add(F.lit("2016-01-01").cast("date"), ((d * 7) % 366).cast("int")),
                                  "MMM dd, EEE")).alias("date_text"),
        _topic_expr(d).alias("topic"),
    ).withColumn("topic_words", topic_words_expr(F.col("topic")))
    if with_label:
        labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
        lab = labels.select(
            F.col("doc_id").alias("journal_id"),
            F.when(F.col("toxic") == 1, F.lit("anger"))
             .when(F.col("quality") == 1, F.lit("joy"))
             .otherwise(F.lit("sadness")).alias("label"))
        out = out.join(lab, "journal_id", "left")
    return out.select(*columns) if columns else out


# ---------------------------------------------------------------------------
# Lookups derived from the given tables.

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blog posts with a latitude: customers, ``c_acctbal`` as the position."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    return c.select(F.col("c_custkey").alias("post_id"),
                    F.col("c_name").alias("trail_name"),
                    F.col("c_acctbal").alias("latitude"))


def shelters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelter lookup: suppliers, ``s_acctbal`` as the position."""
    s = read_table(spark, sf_dir, "supplier", ["s_name", "s_acctbal"])
    return s.select(F.col("s_name").alias("shelter_name"), F.col("s_acctbal").alias("latitude"))


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered club ranges from ``region``: overlapping bands, one inverted.

    ``club_order`` is the file order (first match wins).  The bounds are
    named ``lat_start``/``lat_end``; region 2 has inverted bounds and so
    leaves a gap.
    """
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    k = F.col("r_regionkey")
    start = k * 2000.0 - 1000.0
    end = k * 2000.0 + 1500.0
    return r.select(
        F.col("r_name").alias("trail_club"),
        k.cast("int").alias("club_order"),
        F.when(k == 2, end).otherwise(start).alias("lat_start"),
        F.when(k == 2, start).otherwise(end).alias("lat_end"))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stop_words(version, word)``: short words of the ``benchmark`` texts.

    Version 1 holds words of up to 3 letters, version 2 of up to 2 letters.
    """
    b = read_table(spark, sf_dir, "benchmark", ["text"])
    w = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), 0)).alias("word")).distinct()
    v1 = w.where(F.length("word") <= 3).select(F.lit(1).alias("version"), "word")
    v2 = w.where(F.length("word") <= 2).select(F.lit(2).alias("version"), "word")
    return v1.unionByName(v2)


def english_vocabulary(spark: SparkSession, sf_dir: str, min_docs: int = 2) -> DataFrame:
    """Vocabulary: lowercase words found in at least ``min_docs`` English documents."""
    docs = read_table(spark, sf_dir, "documents", ["text", "lang"]).where(F.col("lang") == "en")
    # de-duplicate inside each document (no shuffle), then count documents
    # per word with a partial aggregation
    words = docs.select(F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), 0))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= min_docs).select("word")
