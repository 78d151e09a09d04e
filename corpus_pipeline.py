"""A training-corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows it keeps with
the columns of ``documents`` (sharding adds ``shard`` and ``slot``).  Each works on all rows of ``docs``, whole texts
included, handles null and empty texts as its operator states, and keeps further columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.llm import decontaminate, langid, mixing, shard, simhash
from trailspark.llm.common import documents, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the training rows; texts without a letter (``und``) go."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.classify(docs, model).where(F.col("__lang_pred") != langid.UNKNOWN).select(docs.columns)


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits of all columns of a row in two numbers: equal rows have equal keys, in every run."""
    plain = [F.col(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(f.name)) for f in docs.schema.fields]
    parts = [p for c in plain for p in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, or of the smallest key (:func:`row_keys`) where ids are equal.

    Rows without an id come after all others of their component, and are kept if no other is.  A row belongs to the
    component of its own text, whatever its id: different texts without an id, or under one id, are different documents.
    """
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_keys(docs), strict=True)))
    rows = simhash.components(keyed, keep=("__k1", "__k2")).groupBy("root", "doc_id", "__k1", "__k2").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__k1", "__k2", "n")).alias("first"))
    kept = materialize(first.select("first.__k1", "first.__k2", "first.n"))
    one = keyed.join(kept.select("__k1", "__k2"), ["__k1", "__k2"], "left_semi").select(*keyed.columns)
    # texts are shuffled once more only if a kept row comes several times, equal in all columns
    return (one if kept.where("n > 1").isEmpty() else one.dropDuplicates(["__k1", "__k2"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words."""
    found = decontaminate.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("__n_hit = 0").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose expected token shares are the target weights.

    Each row is drawn by its id and text: rows without an id, or different texts under one id, are sampled for
    themselves, and rows equal in both share one draw.  Texts are read twice and not shuffled; only the table of cells is joined.
    """
    return mixing.mix(docs.withColumns(mixing.features(docs))).where("__sampled").select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` and their ``slot`` in it (columns of these names are replaced)."""
    keyed = docs.withColumn("__size", shard.text_size()).withColumn("__key", shard.record_key())
    out = shard.assign_shards(keyed)
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*columns, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

# The language model and the fingerprints can't be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
