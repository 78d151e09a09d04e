"""Topic modelling as Spark jobs: terms (T8), class-based TF-IDF words (T13),
topic similarity (T19), document vectors (T7), clustering with outliers and
size-ordered ids (T10), target-count search (T11), topic reduction (T12), assignment back to the journals (T14), per-group
topics (T15) and bar-chart data (T17).

Scale notes: term counting is stop-word removal inside the row (a join only for
a large stop list) -> ``explode`` -> ``groupBy(class, term)`` with map-side partial aggregation,
so the outlier topic -1 holding a third of all documents reaches the
shuffle as one partial row per (partition, term).  Everything after the
counts works on topic-level tables whose size is bounded by the number of
topics and the vocabulary, never by the number of documents.  The only
all-pairs step is the topic x topic similarity matrix (its output *is* the
matrix); it runs on the topic table, in blocks.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import word_terms
from trailspark.operators.cleaning import WordTable
from trailspark.operators.clustering import choose_cut, cut_tree, divisive_tree, keyed_kmeans, points_of
from trailspark.operators.common import rank_within
from trailspark.operators.density import density_clusters
from trailspark.operators.embedding import embed
from trailspark.operators.merging import final_topics, merge_log
from trailspark.session import cut_lineage, materialize


def _kept_terms(docs: DataFrame, stop: DataFrame) -> DataFrame:
    """``cls, t``: the terms of every document without stop words, in order.  The stop words are looked up inside the row;
    with a list too large for that, the places of the terms are joined with it, and the kept ones are put back in order."""
    table = WordTable(stop)
    docs = docs.select("cls", word_terms("_text").alias("_terms"))
    inside = table.inside(docs.where(table.small.scalar()), "t", lambda has: F.filter("_terms", lambda x: ~has(x))).select("cls", "t")
    large = docs.where(~table.small.scalar()).withColumn("_doc", F.monotonically_increasing_id())  # numbered before the terms are exploded
    places = large.select("cls", "_doc", F.posexplode("_terms").alias("_pos", "word")).join(table.words, "word", "left_anti")
    kept = places.groupBy("cls", "_doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "word"))), lambda x: x["word"]).alias("t"))
    return inside.unionByName(kept.select("cls", "t"))


def _bigrams(t: str) -> Column:
    """Pairs of consecutive terms of an array."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def term_counts(df: DataFrame, class_col: str, text_col: str, stop: DataFrame | None = None,
                ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(class, term, tf)``; a term is a run of >= 2 word characters,
    lowercased; stop words (column ``word``) removed as they are given, so a
    capitalised stop word removes nothing.  ``ngram_range=(1, 2)`` adds bigrams
    (T9), formed after stop-word removal.  Stop lists may have any length."""
    docs = df.where(F.col(class_col).isNotNull()).select(F.col(class_col).alias("cls"), F.col(text_col).alias("_text"))
    kept = docs.select("cls", word_terms("_text").alias("t")) if stop is None else _kept_terms(docs, stop)
    t = kept.select("cls", F.explode("t" if ngram_range == (1, 1) else F.concat("t", _bigrams("t"))).alias("term"))
    return t.groupBy("cls", "term").agg(F.count(F.lit(1)).alias("tf")).withColumnRenamed("cls", class_col)


def ctfidf(counts: DataFrame, class_col: str, top_n: int | None = 10) -> DataFrame:
    """Class-based TF-IDF ``w = tf(t,c) * ln(1 + A / f(t))`` with ``A``
    the mean number of terms per class and ``f(t)`` the frequency of ``t``
    over all classes; top ``top_n`` terms per class by ``(w desc, term)``."""
    freq = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    avg_words = counts.agg((F.sum("tf") / F.countDistinct(class_col)).alias("a")).scalar()
    w = (counts.join(freq, "term")
         .withColumn("weight", F.col("tf") * F.log(F.lit(1.0) + avg_words / F.col("f"))))
    return rank_within(w.select(class_col, "term", "weight"), [class_col],
                       [F.desc("weight"), F.asc("term")], top_n)


def topic_words(weights: DataFrame, class_col: str, sep: str = ", ") -> DataFrame:
    """Ranked words per topic as one string (weights dropped)."""
    return weights.groupBy(class_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]),
                     sep).alias("topic_words"))


# ---------------------------------------------------------------------------
# topic vectors and similarity

def centroids(df: DataFrame, topic_col: str, vec_col: str) -> DataFrame:
    """Mean vector per topic from an ``array<float|double>`` column.

    Per-dimension sums are partial aggregations, so a topic holding a third
    of all rows is reduced map-side like any other sum; the result has one
    row per topic.
    """
    base = df.where(F.col(topic_col).isNotNull())
    sizes = base.groupBy(topic_col).agg(F.count(F.lit(1)).alias("n"))
    per_dim = (base.select(topic_col, F.posexplode(vec_col).alias("pos", "x"))
               .groupBy(topic_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    vec = per_dim.groupBy(topic_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    return vec.join(sizes, topic_col)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _unit_vectors(vectors: DataFrame, topic_col: str, vec_col: str) -> DataFrame:
    norm = F.sqrt(_dot(F.col(vec_col), F.col(vec_col)))
    return vectors.select(F.col(topic_col).alias("t"), F.col(vec_col).alias("v"), norm.alias("norm"))


def cosine_pairs(left: DataFrame, right: DataFrame, topic_col: str = "topic", vec_col: str = "centroid",
                 blocks: int = 8) -> DataFrame:
    """``(topic_a, topic_b, similarity)`` for every topic of ``left`` with every
    topic of ``right``.  Topics are dealt to blocks and blocks are joined on a
    key, so pairs are made in ``blocks ** 2`` tasks, none of which holds a whole side."""
    def dealt(df, side, other):
        u = _unit_vectors(df, topic_col, vec_col)
        own = F.pmod(F.xxhash64("t"), F.lit(blocks)).alias(side)
        return u.select(own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias(other), "t", "v", "norm")

    a, b = dealt(left, "i", "j").alias("a"), dealt(right, "j", "i").alias("b")
    return a.join(b, ["i", "j"]).select(
        F.col("a.t").alias("topic_a"), F.col("b.t").alias("topic_b"),
        (_dot(F.col("a.v"), F.col("b.v")) / (F.col("a.norm") * F.col("b.norm"))).alias("similarity"))


def cosine_matrix(vectors: DataFrame, topic_col: str = "topic", vec_col: str = "centroid") -> DataFrame:
    """Long-form ``(topic_a, topic_b, similarity)`` for all topic pairs;
    the result is the full topic x topic matrix by definition."""
    return cosine_pairs(vectors, vectors, topic_col, vec_col)


# ---------------------------------------------------------------------------
# clustering; the vectors are made in ``embedding``, keyed fits and the tree in ``clustering``, merging in ``merging``

def fit_clusters(df: DataFrame, id_col: str, k: int, text_col: str | None = "journal_story", vec_col: str = "vector",
                 keep: tuple[str, ...] = (), seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Seeded k-means over dense vectors: ``(id, keep..., cluster, vec_col)``.

    The vectors are those of the texts (T7, :func:`embedding.embed`), or, with ``text_col=None``, a given array column.
    They are read as they were written for the iterations; the assignment is cut from its lineage.
    """
    from pyspark import StorageLevel
    from pyspark.ml.functions import array_to_vector
    feats = df.select(id_col, *keep, vec_col) if text_col is None else embed(df.select(id_col, *keep, text_col), text_col, out=vec_col)
    feats = feats.withColumn(vec_col, F.col(vec_col).cast("array<double>")).where(F.col(vec_col).isNotNull())
    feats = feats.withColumn("_features", array_to_vector(vec_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(feats)
        return cut_lineage(model.transform(feats).select(id_col, *keep, "cluster", vec_col))
    finally:
        feats.unpersist()


def fit_group_clusters(df: DataFrame, id_col: str, groups: tuple[str, ...], k: Column | int, most: int, text_col: str | None = "journal_story",
                       vec_col: str = "vector", min_rows: int = 2, rounds: int = 20) -> DataFrame:
    """A k-means of its own for every group: ``(id, groups..., cluster)``, all groups in one job.

    ``k`` may be an expression over ``n``, the rows of the group.  Rows with a null group, and groups of fewer
    than ``min_rows`` rows, are left out (:func:`skipped_groups` reports the latter).  Vectors: see :func:`fit_clusters`.
    """
    known = df.dropna(subset=list(groups))
    large = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).drop("_n")
    known = known.join(large, list(groups))
    feats = known.select(id_col, *groups, vec_col) if text_col is None else embed(known.select(id_col, *groups, text_col), text_col, out=vec_col)
    points = materialize(points_of(feats, id_col, vec_col, F.struct(*groups)))
    assigned, _ = keyed_kmeans(points, k, most, rounds)
    return materialize(assigned.select(F.col("id").alias(id_col), "g.*", "cluster"))


def label_topics(clustered: DataFrame, id_col: str, min_topic_size: int, cluster_col: str = "cluster",
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Clusters smaller than ``min_topic_size`` become -1; the others are
    renumbered 0..k-1 by size descending (ties: smallest member id), inside
    each group of ``by`` (T15) if given.  Every row is kept; one whose group or
    cluster is null keeps a null topic.

    Returns ``(id, by..., cluster, topic)``.
    """
    keys = [*by, cluster_col]
    sizes = clustered.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min(id_col).alias("first"))
    kept = rank_within(sizes.where(F.col("size") >= min_topic_size), list(by), [F.desc("size"), F.asc("first")], None, "r")
    ids = kept.select(*keys, (F.col("r") - 1).cast("int").alias("topic"))
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    return (clustered.select(id_col, *keys).join(ids, keys, "left")
            .withColumn("topic", F.when(known, F.coalesce("topic", F.lit(-1)))).select(id_col, *keys, "topic"))


def density_topics(df: DataFrame, id_col: str, vec_col: str, min_cosine: float = 0.8, min_rows: int = 5) -> DataFrame:
    """T10 by density: ``(id, topic)``: clusters of neighbouring core rows, ids by size, and -1 for the rows that none reaches."""
    found = density_clusters(df, id_col, vec_col, min_cosine, min_rows)
    outliers = found.where(F.col("cluster").isNull()).select(id_col, F.lit(-1).alias("topic"))
    return label_topics(found.where(F.col("cluster").isNotNull()), id_col, 1).select(id_col, "topic").unionByName(outliers)


def search_topics(df: DataFrame, id_col: str, target: int, sizes: tuple[int, ...] = (5, 4, 3, 2), text_col: str | None = "journal_story",
                  vec_col: str = "vector") -> DataFrame:
    """Topics of the coarsest cut of one divisive tree that reaches ``target`` topics (-1 included).

    The tree is fitted once.  Of ``sizes``, the largest minimum topic size with which some cut reaches the target is
    taken, or the smallest and the finest cut if none does.

    Returns ``(id, topic, min_topic_size)``.
    """
    feats = df.select(id_col, vec_col) if text_col is None else embed(df.select(id_col, text_col), text_col, out=vec_col)
    members, nodes = divisive_tree(feats, id_col, vec_col, target, sizes)
    min_size, size = choose_cut(nodes, target, sizes)
    cut = cut_tree(members, nodes, min_size, size).withColumnRenamed("id", id_col)
    return label_topics(cut, id_col, min_size, "path").select(id_col, "topic").withColumn("min_topic_size", F.lit(min_size))


def topic_vectors(fitted: DataFrame, id_col: str, topic_col: str = "topic", vec_col: str = "vector") -> DataFrame:
    """``(topic, size, first, centroid)`` of the topics but -1: the mean of the document vectors by a partial aggregation."""
    base = fitted.where(F.col(topic_col) != -1).select(F.col(topic_col).alias("topic"), F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    sizes = base.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("_id").alias("first"))
    return centroids(base, "topic", "_v").select("topic", "centroid").join(sizes, "topic").select("topic", "size", "first", "centroid")


def reduce_topics(assign: DataFrame, log: DataFrame, id_col: str, topic_col: str = "topic", merges: int | None = None) -> DataFrame:
    """The assignments after the first ``merges`` steps of ``log`` (:func:`merging.merge_log`; all by default), ids
    renumbered by size (-1 stays)."""
    ends = final_topics(log, merges).withColumnRenamed("topic", topic_col)
    merged = (assign.join(ends, topic_col, "left")
              .withColumn("_into", F.coalesce("_into", F.when(F.col(topic_col) != -1, F.col(topic_col)))))
    labels = label_topics(merged, id_col, 1, "_into").select(id_col, F.col("topic").alias("_new"))
    return (merged.drop("_into").join(labels, id_col)
            .withColumn(topic_col, F.coalesce("_new", F.col(topic_col))).drop("_new").select(*assign.columns))


def reduce_to(assign: DataFrame, vectors: DataFrame, id_col: str, nr_topics: int, topic_col: str = "topic") -> DataFrame:
    """At most ``nr_topics`` topics, -1 included if there are outliers: the hierarchy is cut where so many are left."""
    log = merge_log(vectors)
    outliers = not assign.where(F.col(topic_col) == -1).isEmpty()
    return reduce_topics(assign, log, id_col, topic_col, max(0, log.count() + 1 - max(1, nr_topics - outliers)))


def skipped_groups(df: DataFrame, by: str, min_rows: int) -> DataFrame:
    """Groups with too few rows to be clustered, and their size."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < min_rows)


def assign_topics(journals: DataFrame, assignments: DataFrame, words: DataFrame, id_col: str = "journal_id",
                  unassigned: int | None = -1) -> DataFrame:
    """T14 (P4 + J9): put ``topic`` and ``topic_words`` on every journal.

    Rows without an assignment get ``unassigned`` (-1, or None to keep
    null); words come from a topic -> words table, '' when absent.
    """
    j = journals.drop("topic", "topic_words").join(assignments.select(id_col, "topic"), id_col, "left")
    if unassigned is not None:
        j = j.withColumn("topic", F.coalesce("topic", F.lit(unassigned)))
    j = j.join(words.select("topic", "topic_words"), "topic", "left")
    return j.withColumn("topic_words", F.when(F.col("topic").isNotNull(), F.coalesce("topic_words", F.lit(""))))


def topic_bar(weights: DataFrame, sizes: DataFrame, class_col: str, n_topics: int = 10, n_words: int = 5) -> DataFrame:
    """The ``n_topics`` largest topics (L5) with their top words and weights."""
    top = rank_within(sizes, [], [F.desc("size"), F.asc(class_col)], n_topics, "topic_rank")
    return (weights.where(F.col("rank") <= n_words).join(F.broadcast(top.select(class_col, "topic_rank")), class_col)
            .select(class_col, "topic_rank", F.col("rank").alias("word_rank"), F.col("term").alias("word"), "weight"))
