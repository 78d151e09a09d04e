"""Helpers shared by the training-data operators.

* :func:`materialize` cuts lineage with a Parquet table in the shared folder
  that the session names in ``spark.checkpoint.dir``; lost executors reread it.
* :func:`connected_components` is the alternating large-star / small-star
  algorithm on DataFrames.
* :func:`map_texts` streams whole texts through Arrow batches of bounded size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arrow batches: rows and bytes held at once by one Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Unset in a local session (tests, a laptop): a scratch folder of its own.
    Unset on a cluster: an error, since a local folder is not shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="trailspark-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, unless the session already set it."""
    for key, value, default in (
            ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS), "10000"),
            ("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES), None)):
        now = spark.conf.get(key, default)
        if now == default or now in ("-1", "9223372036854775807", "2147483647", "67108864", "268435456"):
            spark.conf.set(key, value)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches; texts should be cast to binary."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_bytes(column: str = "text") -> F.Column:
    """Whole UTF-8 text as bytes; null stays null."""
    return F.col(column).cast("binary")


def doc_fold(column: str = "doc_id", folds: int = 3) -> F.Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected edge list: ``node``, ``component``.

    ``component`` is the smallest node reachable; it is given for every node that
    is not itself the smallest of its component (callers coalesce).  Nulls,
    loops and repeated edges are ignored.  Each round joins the edges
    with one pre-aggregated minimum per node, so a hot node stays one row on one side and adaptive
    execution may split the other; rounds are logarithmic and each is written
    to the shared folder, so nothing is collected and lineage stays short.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = materialize(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())

    def signature(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    sig = signature(e)
    while sig[0]:
        # large star: every larger neighbour of v points to v's smallest neighbour (or v)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v"))
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = signature(e)
        if now == sig:
            break
        sig = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
