"""Topics by density (T10): core points, their components, and -1 for what none of them reaches.

Two rows are neighbours if the cosine of their vectors is at least ``min_cosine``.  A row with ``min_rows`` neighbours, itself
included, is a core row; neighbouring core rows are in one cluster; any other row joins the cluster of its most similar
core neighbour, or is an outlier.

Neighbours are looked for in buckets of random projections: ``tables`` codes of signs per vector, each cut so long that its bucket
holds at most ``leaf`` different vectors.  A bucket is one matrix product; every neighbour that it gives is verified by that product,
so a pair is missed only if no table puts it together.  Rows with equal vectors are one row with a weight from the start, so
copies never fill a bucket.  What a bucket sends on is linear in its rows: counts, the few neighbours of rows
that are not yet core rows, and a spanning forest of the links between core rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.session import materialize

TABLES = 12
LEAF = 1024
BITS = 60


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``p, n, v``: each vector (scaled to length one) once, under its smallest id and with the number of its rows."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("_id"), v.alias("_v"), norm.alias("_norm"))
    unit = unit.select("_id", F.when(F.col("_norm") > 0, F.transform("_v", lambda x: x / F.col("_norm"))).otherwise(F.col("_v")).alias("v"))
    return unit.groupBy("v").agg(F.min("_id").alias("p"), F.count(F.lit(1)).alias("n"))


def projection_codes(points: DataFrame, dims: int, tables: int = TABLES, seed: int = 42) -> DataFrame:
    """``p, table, code``: the signs of ``BITS`` random projections per table, the first in the highest bit."""
    planes = np.random.default_rng(seed).standard_normal((tables * BITS, dims))
    shifts = np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                signs = (v @ planes.T > 0).reshape(len(v), tables, BITS).astype(np.int64)
                code = (signs << shifts).sum(axis=2)
                yield pd.DataFrame({"p": np.repeat(pdf["p"].to_numpy(), tables), "table": np.tile(np.arange(tables, dtype=np.int32), len(v)), "code": code.ravel()})

    return points.select("p", "v").mapInPandas(codes, "p long, table int, code long")


def buckets(codes: DataFrame, leaf: int = LEAF, step: int = 3) -> DataFrame:
    """``p, table, length, prefix``: in each table the shortest code prefix (by steps) whose bucket holds at most ``leaf`` points.

    Points that the whole code does not part are dealt to parts of their bucket by a hash.
    """
    rest, length, done = materialize(codes), 0, None
    n = rest.where("table = 0").count()
    while length < BITS and 1 << (length + step) <= max(1, n // leaf):
        length += step
    while True:
        keyed = rest.withColumn("prefix", F.shiftright("code", BITS - length))
        sizes = keyed.groupBy("table", "prefix").agg(F.count(F.lit(1)).alias("_n"))
        over = materialize(sizes.where(F.col("_n") > leaf))
        part = F.lit(0).cast("long")
        if length == BITS:
            keyed = keyed.join(over, ["table", "prefix"], "left").withColumn(
                "part", F.coalesce(F.pmod(F.xxhash64("p"), F.ceil(2 * F.col("_n") / leaf)), part)).drop("_n")
            now = keyed
        else:
            now = keyed.join(over, ["table", "prefix"], "left_anti").withColumn("part", part)
        now = now.select("p", "table", F.lit(length).alias("length"), "prefix", "part")
        done = now if done is None else done.unionByName(now)
        if length == BITS or over.isEmpty():
            return done
        rest = materialize(keyed.join(over.drop("_n"), ["table", "prefix"]).select("p", "table", "code"))
        length = min(BITS, length + step)


BUCKET = ["table", "length", "prefix", "part"]


def _cosines(pdf: pd.DataFrame) -> np.ndarray:
    v = np.stack(pdf["v"].to_numpy())
    return v @ v.T


def core_points(bucketed: DataFrame, min_cosine: float, min_rows: int) -> DataFrame:
    """``p`` of the core points.  A bucket alone may show that a point is one; the neighbours of the others are put together
    over all tables, at most ``min_rows`` of each bucket."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p").reset_index(drop=True)
        near = _cosines(pdf) >= min_cosine
        np.fill_diagonal(near, True)
        n, p = pdf["n"].to_numpy(), pdf["p"].to_numpy()
        enough = near @ n >= min_rows
        a, b = np.nonzero(near & ~enough[:, None])
        return pd.concat([pd.DataFrame({"p": p[enough], "q": p[enough], "n": np.full(enough.sum(), min_rows, np.int64)}),
                          pd.DataFrame({"p": p[a], "q": p[b], "n": n[b].astype(np.int64)})])

    seen = bucketed.groupBy(*BUCKET).applyInPandas(count, "p long, q long, n long")
    once = seen.groupBy("p", "q").agg(F.max("n").alias("n"))
    return once.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows).select("p")


def core_links(bucketed: DataFrame, min_cosine: float) -> DataFrame:
    """``p, q, cosine, core``: a spanning forest of each bucket's links between core points (``core``), and the most similar core
    neighbour that the bucket gives each other point.  ``bucketed`` has ``core``."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p").reset_index(drop=True)
        cos, p, core = _cosines(pdf), pdf["p"].to_numpy(), pdf["core"].to_numpy(bool)
        near = cos >= min_cosine
        out = []
        left = core.copy()
        for k in range(len(p)):  # breadth first from each core point not yet reached; a row of the matrix a step
            if not left[k]:
                continue
            left[k], wave = False, [k]
            while wave:
                at = wave.pop()
                fresh = np.flatnonzero(near[at] & left)
                left[fresh] = False
                wave += fresh.tolist()
                out += [(p[at], p[x], cos[at, x], True) for x in fresh]
        if core.any():
            best = np.where(core[None, :], cos, -2.0)
            pick = best.argmax(axis=1)
            out += [(p[k], p[pick[k]], best[k, pick[k]], False) for k in np.flatnonzero(~core) if best[k, pick[k]] >= min_cosine]
        return pd.DataFrame(out, columns=["p", "q", "cosine", "core"])

    return bucketed.groupBy(*BUCKET).applyInPandas(link, "p long, q long, cosine double, core boolean")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (p, q) reaches, by hooking and pointer doubling.

    A round gives each root the smallest root that an edge leads to, and then halves the ways to the roots until none is
    longer than one step; the written tables have one row per node and per edge between different roots.
    """
    root = materialize(edges.select(F.explode(F.array("p", "q")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    links = materialize(edges.where("p <> q").select("p", "q").distinct())
    while not links.isEmpty():
        both = links.select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"))
        hook = materialize(both.groupBy("p").agg(F.min("q").alias("to")))
        while True:  # p -> to with to < p: no circles
            on = hook.select(F.col("p").alias("to"), F.col("to").alias("next"))
            longer = materialize(hook.join(on, "to", "left").select("p", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")))
            hook = longer.drop("more")
            if longer.where("more").isEmpty():
                break
        root = materialize(root.join(hook.select(F.col("p").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for c in ("p", "q"):
            links = links.join(hook.select(F.col("p").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        links = materialize(links.where("p <> q").distinct())
    return root


def density_clusters(df: DataFrame, id_col: str, vec_col: str, min_cosine: float = 0.8, min_rows: int = 5, tables: int = TABLES,
                     leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """T10 by density: ``(id, cluster)``; ``cluster`` is the smallest id of the cluster's core rows, null for an outlier.

    Rows with a null id or vector are left out; a zero vector is the neighbour of none but equal rows.  Integer ids.
    """
    points = materialize(distinct_vectors(df, id_col, vec_col))
    head = points.select(F.size("v")).first()
    if head is None:
        return df.select(id_col, F.lit(None).cast("long").alias("cluster")).limit(0)
    placed = materialize(buckets(projection_codes(points, head[0], tables, seed), leaf))
    core = materialize(core_points(placed.join(points, "p"), min_cosine, min_rows))
    flagged = points.join(core.withColumn("core", F.lit(True)), "p", "left").fillna(False, ["core"])
    links = materialize(core_links(placed.join(flagged, "p"), min_cosine))
    roots = smallest_reachable(links.where("core"))
    known = core.join(roots.withColumnRenamed("node", "p"), "p", "left").select("p", F.coalesce("root", "p").alias("cluster"))
    border = links.where("NOT core").groupBy("p").agg(F.min_by("q", F.struct((-F.col("cosine")).alias("s"), "q")).alias("q"))
    border = border.join(known.withColumnRenamed("p", "q"), "q").select("p", "cluster")
    of_vector = points.join(known.unionByName(border), "p", "left").select("v", "cluster")
    # rows of one vector share its fate: back from the vector to the ids
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        id_col, F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v).alias("v"))
    return rows.join(of_vector, "v").select(id_col, "cluster")
