"""Registered queries that go through files: written in the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailspark.functions.geo import lenient_double
from trailspark.operators import reports as R
from trailspark.operators import sentiment as SN
from trailspark.session import ensure_checkpoint_dir
from trailspark.sources import files as SF
from trailspark.sources import tables as S


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _write_named(df, column: str, folder: str) -> str:
    """CSV files in one folder, named ``<value of column>.<number>.csv``: one rename per file written."""
    spark, parts = df.sparkSession, f"{folder}-parts"
    SF.write_table(df.repartition(column), parts, "csv", partition_by=[column])
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    for k, found in enumerate(store.globStatus(path(f"{parts}/{column}=*/*.csv"))):
        value = found.getPath().getParent().getName().split("=", 1)[1]
        store.rename(found.getPath(), path(f"{folder}/{value}.{k:05d}.csv"))
    return folder


def csv_round_trip(spark, sf_dir):
    """Journals written as CSV under the reference's column names, read back and renamed; whole texts with
    quotes and line breaks come back as they were."""
    d = S.read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    folder = _folder(spark)
    SF.write_table(d.select("doc_id", F.col("text").alias("Journal Story"), F.col("lang").alias("Topic Words")), folder, "csv")
    back = SF.canonical(SF.read_csv(spark, folder), ["journal_story", "topic_words"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("journal_story").cast("binary"), 256).alias("story_sha256"),
                       F.length("journal_story").cast("long").alias("n_chars"), F.col("topic_words").alias("lang"))


def csv_row_index(spark, sf_dir):
    """Rows of several CSV files numbered in the order of files and lines."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_name", "state"])
    folder = _folder(spark)
    SF.write_table(j.repartitionByRange(5, "journal_id").sortWithinPartitions("journal_id"), folder, "csv")
    back = SF.with_row_index(SF.read_csv(spark, folder), "row_index")
    return back.select("row_index", F.col("journal_id").cast("long").alias("journal_id"), "trail_name", "state")


def csv_folder_union(spark, sf_dir):
    """A folder of files whose headers differ, combined by name."""
    a = S.read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = S.read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"]).select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    folder = _folder(spark)
    SF.write_table(a, f"{folder}/a", "csv")
    SF.write_table(b, f"{folder}/b", "csv")
    both = SF.combine_csv_folder(spark, f"{folder}/*")
    return both.select("source_no", F.col("id").cast("long").alias("id"), "name", F.col("acctbal").cast("double").alias("acctbal"),
                       "segment", F.col("nationkey").cast("long").alias("nationkey"))


def year_dated_files(spark, sf_dir):
    """Q15 whole: files named by their year, the year put behind each date, rows without a position dropped, one output
    per input year, read back."""
    o = S.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"])
    named = _write_named(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("latitude"), F.col("o_custkey").alias("longitude"),
                                  F.date_format("o_orderdate", "MMM dd, EEE").alias("date_text"), F.year("o_orderdate").alias("year")), "year", _folder(spark))
    rows = SF.with_file_stem(SF.read_csv(spark, named), "year").dropna(how="any", subset=["latitude", "longitude"])
    rows = rows.withColumn("date_text", F.concat(F.col("date_text"), F.lit(", "), F.col("year")))
    out = _folder(spark)
    SF.write_table(rows, out, partition_by=["year"])
    return spark.read.parquet(out).select(
        F.col("row_id").cast("long").alias("row_id"), lenient_double("latitude").alias("latitude"), lenient_double("longitude").alias("longitude"),
        "date_text", F.col("year").cast("string").alias("year"))


def split_label_files(spark, sf_dir):
    """Q19/K7: one output per label, read back and counted; rows without a label are not written."""
    j = S.journals(spark, sf_dir, with_label=True, columns=["journal_id", "label", "trail_club"]).where(F.col("label").isNotNull())
    out = _folder(spark)
    SF.write_table(j, out, "csv", partition_by=["label"])
    back = SF.read_csv(spark, out)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("journal_id").cast("long")).alias("first_id"),
                                     F.max(F.col("journal_id").cast("long")).alias("last_id"), F.count("trail_club").alias("with_club"))


def location_entry_cells(spark, sf_dir):
    """The joined entries of each coordinate, in chunks of bounded size; chunks are given by their digest."""
    from trailspark.plans.location import location_top3_entries
    cells = R.entry_cells(location_top3_entries(spark, sf_dir))
    return cells.select("location_name", "latitude", "longitude", "top_topics", "chunk", "n_entries",
                        F.sha2(F.col("journal_entries").cast("binary"), 256).alias("entries_sha256"))


def score_argmax(spark, sf_dir):
    """The class of a score vector: place of its first maximum."""
    e = S.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", SN.argmax("embedding").alias("best"))


QUERIES = {f.__name__: f for f in (csv_round_trip, csv_row_index, csv_folder_union, year_dated_files, split_label_files,
                                   location_entry_cells, score_argmax)}
