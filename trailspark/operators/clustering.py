"""Keyed clustering: k-means of all groups in one job (T15), and a divisive tree of two-means splits.

The key is part of every step: starts are ranked inside their group, points meet the centres of their group in a join,
and one aggregation by (group, cluster) moves the centres of all groups.  No loop runs over groups, and no group is one
task: a group with a third of all points is summed map-side like any other.  A group whose centres stand still
leaves the rounds.  The centres of a group (clusters x dimensions) are one row; points are never collected.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.common import rank_within
from trailspark.session import materialize

ROUNDS = 20
# Centres that move less than this stand still.
TOLERANCE = 1e-9
# Points of a tree node that one task splits further by itself.
TASK_POINTS = 1 << 14
# A split of the tree is good enough when its centres (of unit vectors) move less than this.
SPLIT_TOLERANCE = 1e-2


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _centre(number, vector) -> Column:
    return F.struct(number.cast("int").alias("cluster"), vector.alias("c"), (dot(vector, vector) / 2).alias("half"))


def nearest(vector: Column, centres: Column) -> Column:
    """Number of the nearest centre (ties: the smallest number): the largest of <v, c> - |c|^2 / 2."""
    best = F.array_max(F.transform(centres, lambda c: F.struct((dot(vector, c["c"]) - c["half"]).alias("s"), (-c["cluster"]).alias("n"))))
    return -best["n"]


def points_of(df: DataFrame, id_col: str, vec_col: str, group: Column | None = None) -> DataFrame:
    """``g, id, v`` of the rows whose group, id and vector are not null; without ``group`` all rows are one group."""
    g = F.lit(0) if group is None else group
    return df.select(g.alias("g"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).dropna()


def starts(points: DataFrame, k: Column | int, most: int) -> DataFrame:
    """First model ``g, centres``: in every group the points of the k smallest id hashes (MD5 of the id as text).

    ``k`` may be an expression over ``n``, the points of the group; it is at most ``most``.  The starts do not depend on how
    the points are partitioned.
    """
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    sizes = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("g", F.least(F.lit(most), k if isinstance(k, Column) else F.lit(k)).alias("_k"))
    first = rank_within(points, ["g"], order, most, "_r").join(wanted, "g").where(F.col("_r") <= F.col("_k"))
    return first.groupBy("g").agg(F.array_sort(F.collect_list(_centre(F.col("_r") - 1, F.col("v")))).alias("centres"))


def moved(points: DataFrame, model: DataFrame, dims: int) -> DataFrame:
    """The model after one round: ``g, centres, shift`` with the means of the assigned points; an empty cluster keeps its centre."""
    assigned = points.join(model, "g").select("g", nearest(F.col("v"), F.col("centres")).alias("cluster"), "v")
    sums = assigned.groupBy("g", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims)]).alias("s"))
    means = sums.select("g", "cluster", F.transform("s", lambda x: x / F.col("n")).alias("mean"))
    old = model.select("g", F.explode("centres").alias("o")).select("g", "o.cluster", F.col("o.c").alias("c"))
    new = old.join(means, ["g", "cluster"], "left").select("g", "cluster", F.coalesce("mean", "c").alias("c"), F.coalesce(
        F.array_max(F.transform(F.arrays_zip("mean", "c"), lambda z: F.abs(z["mean"] - z["c"]))), F.lit(0.0)).alias("d"))
    return new.groupBy("g").agg(F.array_sort(F.collect_list(_centre(F.col("cluster"), F.col("c")))).alias("centres"), F.max("d").alias("shift"))


def keyed_kmeans(points: DataFrame, k: Column | int, most: int = 64, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """K-means of every group of ``points`` (:func:`points_of`): ``(g, id, cluster), model``.

    Each group gets the result that a fit of its own would give from the same :func:`starts`.  ``model`` is written and holds
    ``g, centres, round``, the round in which the group came to rest (``rounds`` if it did not).
    """
    first = points.select(F.size("v")).first()
    model = materialize(starts(points, k, most))
    resting = None
    for r in range(1, rounds + 1):
        if first is None:
            break
        now = materialize(moved(points, model, first[0]))
        still = now.where((F.col("shift") <= tolerance) | F.lit(r == rounds)).select("g", "centres", F.lit(r).alias("round"))
        resting = still if resting is None else resting.unionByName(still)
        model = now.where(F.col("shift") > tolerance).select("g", "centres")
        if model.isEmpty():
            break
    model = materialize(model.select("g", "centres", F.lit(0).alias("round")) if resting is None else resting)
    assigned = points.join(model.select("g", "centres"), "g").select("g", "id", nearest(F.col("v"), F.col("centres")).alias("cluster"))
    return assigned, model


# ---------------------------------------------------------------------------
# a divisive tree: every node is split by two-means, all nodes of a level in one job

def divisive_tree(df: DataFrame, id_col: str, vec_col: str, target: int, min_sizes: tuple[int, ...] = (5, 4, 3, 2),
                  task_points: int = TASK_POINTS, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """One tree over all points: ``members (id, path), nodes (path, size, left, right)``, both written.

    ``path`` is the string of turns from the root; ``left`` and ``right`` are the sizes of a split node's children, null
    where a node was not split.  Nodes of more than ``task_points`` points are split level by level, all nodes of a level in one keyed
    fit; a smaller node is split further inside one task, in the same way.  Nodes are split down to a size that
    falls until, for the largest of ``min_sizes``, the topics of the split nodes larger than every node left whole reach ``target``
    (:func:`topics_at`), or until no node can be split so that a child holds the smallest of ``min_sizes``.
    """
    small, large = min(min_sizes), max(min_sizes)
    points = materialize(points_of(df, id_col, vec_col).select(F.lit("").alias("path"), "id", "v"))
    total = points.count()
    nodes = materialize(points.groupBy("path").agg(F.count(F.lit(1)).alias("size")).select(
        "path", "size", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.lit(True).alias("open")))
    floor = max(small + 1, total // max(1, 4 * target))
    while True:
        while True:  # a level of the large nodes
            wanted = nodes.where(F.col("open") & (F.col("size") > task_points) & (F.col("size") >= floor)).select(F.col("path").alias("g"))
            if wanted.isEmpty():
                break
            split = points.withColumnRenamed("path", "g").join(wanted, "g")
            assigned = materialize(keyed_kmeans(split, 2, 2, rounds, SPLIT_TOLERANCE)[0])
            children = assigned.groupBy("g").agg(F.count_if(F.col("cluster") == 0).alias("left"), F.count_if(F.col("cluster") == 1).alias("right"))
            children = children.where((F.col("left") > 0) & (F.col("right") > 0) & (F.greatest("left", "right") >= small))
            children = materialize(wanted.join(children, "g", "left").withColumnRenamed("g", "path"))
            side = assigned.join(children.where(F.col("left").isNotNull()).select(F.col("path").alias("g")), "g").select(
                "id", F.concat("g", F.col("cluster").cast("string")).alias("_path"))
            points = materialize(points.join(side, "id", "left").select(F.coalesce("_path", "path").alias("path"), "id", "v"))
            fresh = children.where(F.col("left").isNotNull()).select(F.col("path").alias("_p"), F.posexplode(F.array("left", "right")).alias("turn", "size"))
            fresh = fresh.select(F.concat("_p", F.col("turn").cast("string")).alias("path"), "size", F.lit(None).cast("long").alias("left"),
                                 F.lit(None).cast("long").alias("right"), F.lit(True).alias("open"))
            done = children.join(nodes.select("path", "size"), "path").select("path", "size", "left", "right", F.lit(False).alias("open"))
            nodes = materialize(nodes.join(children.select("path"), "path", "left_anti").unionByName(done).unionByName(fresh))
        inside = points.join(nodes.where(F.col("open") & (F.col("size") <= task_points) & (F.col("size") >= floor)).select("path"), "path")
        grown = materialize(inside.groupBy("path").applyInPandas(
            lambda pdf: _grow(pdf, floor, small, rounds), "id long, way string, size long, left long, right long, open boolean, old string"))
        ways = grown.where("size IS NULL").select("id", F.col("way").alias("_path"))
        points = materialize(points.join(ways, "id", "left").select(F.coalesce("_path", "path").alias("path"), "id", "v"))
        known = grown.where("size IS NOT NULL").select(F.col("way").alias("path"), "size", "left", "right", "open")
        nodes = materialize(nodes.join(grown.select(F.col("old").alias("path")).distinct(), "path", "left_anti").unionByName(known))
        largest = nodes.where("open").agg(F.max("size")).first()[0] or 0
        if largest <= small or topics_at(nodes, large, largest + 1) >= target:
            return points.select("id", "path"), nodes.drop("open")
        floor = max(small + 1, min(floor // 4, largest))


def _two_means(v: np.ndarray, rounds: int) -> np.ndarray:
    """Cluster (0 or 1) of points in the order of their starts, as :func:`keyed_kmeans` with k = 2 gives it."""
    c = v[:2].copy()
    label = lambda: (v @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
    for _ in range(rounds):
        a = label()
        new = np.stack([v[a == j].mean(axis=0) if (a == j).any() else c[j] for j in (0, 1)])
        shift, c = np.abs(new - c).max(), new
        if shift <= SPLIT_TOLERANCE:
            break
    return label()


def _grow(pdf: pd.DataFrame, floor: int, small: int, rounds: int) -> pd.DataFrame:
    """The subtree of one node, split down to nodes below ``floor``: a row per node, and the way to its leaf for each point."""
    ids = pdf["id"].to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (md5(str(ids[i]).encode()).hexdigest(), ids[i]))
    ids, v, top = ids[order], np.stack(pdf["v"].to_numpy()[order]), pdf["path"].iloc[0]
    rows, waiting = [], [(top, np.arange(len(ids)))]
    while waiting:
        way, at = waiting.pop()
        if len(at) < floor:
            rows += [(None, way, len(at), None, None, True, top), *((i, way, None, None, None, None, top) for i in ids[at])]
            continue
        right = _two_means(v[at], rounds).astype(bool) if len(at) > 1 else np.zeros(len(at), bool)
        n = int(right.sum())
        if 0 < n < len(at) and max(n, len(at) - n) >= small:
            rows.append((None, way, len(at), len(at) - n, n, False, top))
            waiting += [(way + "0", at[~right]), (way + "1", at[right])]
        else:
            rows += [(None, way, len(at), None, None, False, top), *((i, way, None, None, None, None, top) for i in ids[at])]
    out = pd.DataFrame(rows, columns=["id", "way", "size", "left", "right", "open", "old"])
    return out.astype({"id": "Int64", "size": "Int64", "left": "Int64", "right": "Int64", "open": "boolean"})


def _gain(min_size: int) -> Column:
    """Topics that a split adds: one if both children are topics, none if one child is too small (its rows become outliers),
    and one less if both are."""
    topic = lambda c: (F.col(c) >= min_size).cast("int")
    return topic("left") + topic("right") - topic("size")


def topics_at(nodes: DataFrame, min_size: int, size: int | None) -> int:
    """Topics (-1 included, if there are outliers) of the cut that splits every node of at least ``size`` rows.

    Children are smaller than their parent, so the split nodes are the top of the tree, and its leaves are counted by the gains
    of the split nodes alone.  A split that would leave no topic is not made.
    """
    cut = nodes.where(F.col("left").isNotNull() & (F.col("size") >= (size or 0)) & (F.greatest("left", "right") >= min_size))
    row = cut.agg(F.sum(_gain(min_size)).alias("gain"), F.max((F.least("left", "right") < min_size).cast("int")).alias("out")).first()
    return 1 + (row["gain"] or 0) + (row["out"] or 0)


def choose_cut(nodes: DataFrame, target: int, min_sizes: tuple[int, ...] = (5, 4, 3, 2)) -> tuple[int, int]:
    """(min_size, size): the largest minimum topic size with which some cut reaches ``target``, and the coarsest such cut.

    If none does, the smallest minimum size and the finest cut.
    """
    for m in sorted(min_sizes, reverse=True):
        splits = nodes.where(F.col("left").isNotNull() & (F.greatest("left", "right") >= m))
        by_size = splits.groupBy("size").agg(F.sum(_gain(m)).alias("gain"), F.max((F.least("left", "right") < m).cast("int")).alias("out"))
        down = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)  # one row per size of a node
        reached = by_size.select("size", (1 + F.sum("gain").over(down) + F.max("out").over(down)).alias("topics")).where(F.col("topics") >= target)
        size = reached.agg(F.max("size")).first()[0]
        if size is not None:
            return m, size
    return min(min_sizes), 0


def cut_tree(members: DataFrame, nodes: DataFrame, min_size: int, size: int) -> DataFrame:
    """``id, path`` where ``path`` is the node of the cut that holds the row: the first on its way from the root that is not split."""
    whole = nodes.where(F.col("left").isNull() | (F.col("size") < size) | (F.greatest("left", "right") < min_size)).select(F.col("path").alias("node"))
    ways = members.select("path").distinct().select("path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda k: F.substring("path", F.lit(1), k))).alias("node"))
    ends = ways.join(whole, "node").groupBy("path").agg(F.min_by("node", F.length("node")).alias("node"))
    return members.join(ends, "path").select("id", F.col("node").alias("path"))
