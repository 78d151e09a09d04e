import math

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def fixture():
    r = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = r.normal(size=(12, 16))
        for k in range(150):
            v = base[k % 12] + r.normal(size=16) * r.choice([0.02, 0.1, 0.2, 0.6])
            rows.append((v.astype(np.float32).tolist(), label))
    rows += [rows[3]] * 60 + [([2 * x for x in rows[5][0]], 0)]  # copies and a multiple
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([None] + [1.0] * 15, 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] * 16, 0),
             (rows[0][0], None), (rows[0][0], None), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([1e-30] * 16, 1), ([3e37] * 16, 1)]
    return [(k, v, y) for k, (v, y) in enumerate(rows)]


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


@pytest.mark.parametrize("tile", [1024, 40])
def test_equal_brute_force(spark, tile):
    rows = fixture()
    ok = {k for k, v, y in rows if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    by = {k: (v, y) for k, v, y in rows}
    link = lambda a, b: a in ok and b in ok and by[a][1] == by[b][1] and len(by[a][0]) == len(by[b][0]) and cosine(by[a][0], by[b][0]) >= 0.98
    want = H.components(by, link)
    n = {k: 0 for k in by}
    for a in by:
        for b in by:
            if a < b and link(a, b):
                n[a] += 1
                n[b] += 1
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash"))
    got = embeddings.near_duplicates(df, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (n[k], want[k], want[k] == k) for k in by}
    assert len(got) == len(rows) and max(n.values()) > 60


def test_bounds_are_rigorous():
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 64)) * r.choice([0.01, 1, 5], size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, n, e = embeddings.quantise(x)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    bound = e[:, None] * n + n[:, None] * e + e[:, None] * e
    assert (np.abs(x @ x.T - near) <= bound + 1e-12).all() and bound.max() < 0.2


def test_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.001], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
