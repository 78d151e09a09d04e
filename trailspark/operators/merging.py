"""Topic reduction and hierarchy (T12, T18) by rounds of mutual nearest neighbours.

Topics are merged by average linkage: the similarity of two clusters is the mean cosine over all pairs of their topics,
weighted by topic size, which is the dot product of their mean unit vectors.  A merged cluster is never more similar to a
third one than the more similar of its parts was, so two clusters that are each other's most similar can be merged at once,
whatever else is merged in the same round, and the merges sorted by similarity are those of the plain loop that always
merges the most similar pair.  Every topic finds its nearest by blocks of the topic table; no vector reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.clustering import dot
from trailspark.session import materialize

# Topics in a block; two blocks are compared in one matrix product.
BLOCK = 512


def unit_topics(vectors: DataFrame, topic: str = "topic", size: str = "size", first: str = "first", vec: str = "centroid") -> DataFrame:
    """``topic, size, first, v`` with vectors of length one (zero stays zero)."""
    norm = F.sqrt(dot(F.col(vec), F.col(vec)))
    return vectors.select(F.col(topic).alias("topic"), F.col(size).cast("double").alias("size"), F.col(first).alias("first"),
                          F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(F.col(vec)).cast("array<double>").alias("v"))


def nearest_topics(topics: DataFrame, block: int = BLOCK) -> DataFrame:
    """``topic, other, similarity``: the most similar other topic of each; ties go to the pair of smaller numbers (smaller, then larger).

    Topics are numbered into blocks; a pair of blocks meets in one task, which sends the best of each row.
    """
    blocks = max(1, -(-topics.count() // block))
    dealt = topics.select("topic", "v", F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int").alias("b"))
    packed = dealt.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("topic", "v"))).alias("rows"))  # about `block` topics
    packed = materialize(packed.select("b", F.transform("rows", lambda r: r["topic"].cast("long")).alias("t"),
                                       F.flatten(F.transform("rows", lambda r: r["v"])).alias("v")))
    others = packed.select(F.col("b").alias("b2"), F.col("t").alias("t2"), F.col("v").alias("v2"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    pairs = packed.join(others, "b").select("t", "v", "t2", "v2").repartition(min(blocks * blocks, 4096), "t", "t2")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ta, va, tb, vb = (np.asarray(batch.column(c)[k].values) for c in range(4))
                sim = va.reshape(len(ta), -1) @ vb.reshape(len(tb), -1).T
                sim[ta[:, None] == tb[None, :]] = -np.inf
                top = sim.max(axis=1, keepdims=True)
                lo, hi = np.minimum(ta[:, None], tb[None, :]), np.maximum(ta[:, None], tb[None, :])
                lo = np.where(sim == top, lo, np.iinfo(np.int64).max)
                low = lo.min(axis=1, keepdims=True)
                pick = np.where(lo == low, hi, np.iinfo(np.int64).max).argmin(axis=1)
                ok = np.isfinite(top[:, 0])
                yield pa.RecordBatch.from_pydict({"topic": ta[ok], "other": tb[pick][ok], "similarity": top[ok, 0]})

    found = pairs.mapInArrow(best, "topic long, other long, similarity double")
    order = F.struct((-F.col("similarity")).alias("s"), F.least("topic", "other").alias("lo"), F.greatest("topic", "other").alias("hi"))
    return found.groupBy("topic").agg(F.min_by(F.struct("other", "similarity"), order).alias("x")).select("topic", "x.*")


def merge_log(vectors: DataFrame, min_similarity: float | None = None, block: int = BLOCK) -> DataFrame:
    """``step, topic, into, similarity``: all merges, the most similar first (ties: smaller topic numbers).

    ``vectors`` (``topic, size, first, centroid``) has one row per topic.  Of two clusters the smaller goes into the larger
    (ties: the later ``first`` goes); a cluster keeps the number of the topic that the others went into.  With
    ``min_similarity`` merges below it are not made.  Rounds of mutual nearest neighbours are made while there are more than
    ``block`` clusters, each written; the last ``block`` clusters are merged in one task.
    """
    topics = materialize(unit_topics(vectors).withColumn("topic", F.col("topic").cast("long")))
    log = None
    while topics.count() > block:
        near = materialize(nearest_topics(topics, block))
        # the pair is mutual if the other one's nearest is this topic; a tie has one order of pairs, so some pair always is
        mutual = near.alias("a").join(near.alias("b"), (F.col("a.other") == F.col("b.topic")) & (F.col("b.other") == F.col("a.topic"))
                                      & (F.col("a.topic") < F.col("a.other")))
        mutual = mutual.select(F.col("a.topic").alias("x"), F.col("a.other").alias("y"), F.greatest("a.similarity", "b.similarity").alias("similarity"))
        if min_similarity is not None:
            mutual = mutual.where(F.col("similarity") >= min_similarity)
        order = F.struct((-F.col("size")).alias("s"), "first", "topic").alias("o")  # the larger, then the earlier stays
        sides = [topics.select(F.col("topic").alias(c), F.struct("size", order, "first", "v").alias(f"_{c}")) for c in "xy"]
        pairs = mutual.join(sides[0], "x").join(sides[1], "y")
        keep_x = F.col("_x.o") < F.col("_y.o")
        pairs = materialize(pairs.select(
            F.when(keep_x, F.col("y")).otherwise(F.col("x")).alias("topic"), F.when(keep_x, F.col("x")).otherwise(F.col("y")).alias("into"), "similarity",
            (F.col("_x.size") + F.col("_y.size")).alias("size"), F.least("_x.first", "_y.first").alias("first"),
            F.zip_with("_x.v", "_y.v", lambda a, b: (a * F.col("_x.size") + b * F.col("_y.size")) / (F.col("_x.size") + F.col("_y.size"))).alias("v")))
        if pairs.isEmpty():
            break
        step = pairs.select("topic", "into", "similarity")
        log = step if log is None else log.unionByName(step)
        gone = pairs.select(F.explode(F.array("topic", "into")).alias("topic"))
        topics = materialize(topics.join(gone, "topic", "left_anti").unionByName(pairs.select(F.col("into").alias("topic"), "size", "first", "v")))
    else:
        rest = topics.groupBy(F.lit(0).alias("all")).applyInPandas(  # at most `block` rows
            lambda pdf: _merge_rest(pdf, min_similarity), "topic long, into long, similarity double")
        log = rest if log is None else log.unionByName(rest)
    order = Window.orderBy(F.desc("similarity"), F.least("topic", "into"), F.greatest("topic", "into"))  # one row per topic
    return materialize(log.select(F.row_number().over(order).alias("step"), F.col("topic").cast("int").alias("topic"), F.col("into").cast("int").alias("into"), "similarity"))


def _merge_rest(pdf: pd.DataFrame, floor: float | None) -> pd.DataFrame:
    """All merges of a table of topics, the most similar pair first; a merge changes one row of the similarities."""
    pdf = pdf.sort_values("topic")
    topic, size, first = (pdf[c].to_list() for c in ("topic", "size", "first"))
    v, log = np.stack(pdf["v"].to_numpy()), []
    sim = v @ v.T
    sim[np.tril_indices(len(v))] = -np.inf  # a pair is (smaller, larger) topic number
    for _ in range(len(v) - 1):
        a, b = divmod(int(sim.argmax()), len(v))
        if floor is not None and sim[a, b] < floor:
            break
        y, x = sorted((a, b), key=lambda i: (-size[i], first[i], topic[i]))
        log.append((topic[x], topic[y], sim[a, b]))
        v[y] = (v[y] * size[y] + v[x] * size[x]) / (size[x] + size[y])
        size[y], first[y] = size[x] + size[y], min(first[x], first[y])
        live = np.isfinite(sim[y, :]) | np.isfinite(sim[:, y])
        live[x] = False
        sim[x, :] = sim[:, x] = -np.inf
        now = v @ v[y]
        after = np.arange(len(v)) > y
        sim[y, live & after], sim[live & ~after, y] = now[live & after], now[live & ~after]
    return pd.DataFrame(log, columns=["topic", "into", "similarity"]).astype({"topic": "int64", "into": "int64", "similarity": "float64"})


def final_topics(log: DataFrame, merges: int | None = None) -> DataFrame:
    """``topic, _into``: where each merged topic ends after the first ``merges`` steps (all by default), by pointer doubling."""
    to = materialize(log.where(F.lit(True) if merges is None else F.col("step") <= merges).select("topic", F.col("into").alias("_into")))
    while True:
        on = to.select(F.col("topic").alias("_into"), F.col("_into").alias("_next"))
        now = materialize(to.join(on, "_into", "left").select("topic", F.coalesce("_next", "_into").alias("_into"), F.col("_next").isNotNull().alias("moved")))
        to = now.drop("moved")
        if now.where("moved").isEmpty():
            return to
