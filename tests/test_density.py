"""Density clusters against a plain restatement, and the recall of the projected buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.operators import density as D
from trailspark.operators import topics as T

pytestmark = pytest.mark.usefixtures("few_partitions")


def plain(rows, min_cosine, min_rows):
    """{id: cluster or None} by comparing all pairs."""
    ids = [i for i, v in rows if i is not None and v is not None]
    v = np.array([v for i, v in rows if i is not None and v is not None], float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    same = (v[:, None, :] / np.where(norm > 0, norm, 1)[:, None] == v[None] / np.where(norm > 0, norm, 1)[None]).all(2)
    v = v / np.where(norm > 0, norm, 1)
    cos = v @ v.T
    near = (cos >= min_cosine) | same
    core = near.sum(1) >= min_rows
    root = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(core):
            low = min(root[ids[b]] for b in np.flatnonzero(near[a] & core))
            changed, root[ids[a]] = changed or low != root[ids[a]], low
    out = {}
    for a, i in enumerate(ids):
        if core[a]:
            out[i] = root[i]
        else:
            own = [(-cos[a, b], ids[b]) for b in np.flatnonzero(near[a] & core)]
            out[i] = root[min(own)[1]] if own else None
    return out


def cloud(rng, n, spread, dims=8):
    middle = rng.normal(size=(6, dims))
    return middle[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("seed,min_rows", [(1, 4), (2, 9)])
def test_equal_to_all_pairs(spark, seed, min_rows):
    rng = np.random.default_rng(seed)
    v = np.r_[cloud(rng, 150, 0.25), rng.normal(size=(40, 8))].tolist()
    rows = [(int(i), x) for i, x in zip(rng.permutation(1000), v, strict=False)]
    rows += [(2000 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(5)] + [(3000, [0.0] * 8), (None, v[0]), (3001, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r.id: r.cluster for r in D.density_clusters(df, "id", "x", 0.85, min_rows).collect()}
    want = plain(rows, 0.85, min_rows)
    assert got == want and None in want.values() and len(set(want.values())) > 3
    topics = {r.id: r.topic for r in T.density_topics(df, "id", "x", 0.85, min_rows).collect()}
    assert {i for i, t in topics.items() if t == -1} == {i for i, c in want.items() if c is None}


def test_buckets_are_bounded_and_recall_is_high(spark):
    rng = np.random.default_rng(4)
    v = cloud(rng, 900, 0.2, 16)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, x array<double>")
    pts = D.distinct_vectors(df, "id", "x")
    placed = D.buckets(D.projection_codes(pts, 16), 64)
    sizes = placed.groupBy(*D.BUCKET).count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 and placed.count() == 900 * D.TABLES
    seen = {}
    for r in placed.collect():
        seen.setdefault(r.p, set()).add((r.table, r.length, r.prefix, r.part))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    found = np.mean([bool(seen[i] & seen[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert len(a) > 1000 and found >= 0.9, found


def test_copies_are_one_point_and_equal_codes_are_dealt(spark):
    rows = [(k, [1.0, 0.0]) for k in range(500)] + [(600 + k, [0.0, 1.0 + k]) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert D.distinct_vectors(df, "id", "x").count() == 2
    got = {r.id: r.cluster for r in D.density_clusters(df, "id", "x", 0.9, 4).collect()}
    assert {got[k] for k in range(500)} == {0} and [got[600 + k] for k in range(3)] == [None] * 3
    codes = spark.range(300).select(F.col("id").alias("p"), F.lit(0).alias("table"), F.lit(7).cast("long").alias("code"))
    assert D.buckets(codes, leaf=40, step=12).groupBy(*D.BUCKET).count().agg(F.max("count")).first()[0] <= 40
    assert D.density_clusters(df.limit(0), "id", "x").count() == 0


def test_smallest_reachable(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000 + k, 5000) for k in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in D.smallest_reachable(spark.createDataFrame(edges, "p long, q long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
