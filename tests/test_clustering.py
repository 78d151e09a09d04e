"""Keyed clustering, the divisive tree, dense vectors and topic merging against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.operators import clustering as C
from trailspark.operators import embedding as E
from trailspark.operators import merging as M

pytestmark = pytest.mark.usefixtures("few_partitions")


def lloyd(ids, v, k, rounds):
    """A separate fit of one group from the same starts."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
    c = v[order[:k]].copy()
    label = lambda: (v @ c.T - (c * c).sum(1) / 2).argmax(1)
    for _ in range(rounds):
        a = label()
        new = np.array([v[a == j].mean(0) if (a == j).any() else c[j] for j in range(len(c))])
        still = np.abs(new - c).max() <= C.TOLERANCE
        c = new
        if still:
            break
    return dict(zip(ids, label().tolist(), strict=True))


def groups(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in (("hot", 400), ("b", 60), ("c", 9), ("one", 1), ("same", 8)):
        middle = rng.normal(size=(4, 5)) * 3
        v = middle[rng.integers(0, 4, n)] + rng.normal(size=(n, 5))
        rows += [(g, x.tolist()) for x in (np.ones((n, 5)) if g == "same" else v)]
    return [(k, g, v) for k, (g, v) in enumerate(rows)]


def test_keyed_kmeans_equals_a_fit_per_group(spark):
    rows = groups()
    df = spark.createDataFrame([*rows, (9000, None, [1.0] * 5), (9001, "b", None)], "id long, g string, v array<double>")
    k = lambda n: min(6, max(1, n // 10))
    pts = C.points_of(df, "id", "v", F.col("g"))
    assigned, model = C.keyed_kmeans(pts, F.greatest(F.lit(1), F.floor(F.col("n") / 10)).cast("int"), 6)
    got = {r.id: (r.g, r.cluster) for r in assigned.collect()}
    assert set(got) == {i for i, _, _ in rows}
    for g in {g for _, g, _ in rows}:
        own = [(i, v) for i, x, v in rows if x == g]
        want = lloyd([i for i, _ in own], np.array([v for _, v in own]), k(len(own)), C.ROUNDS)
        assert {i: c for i, (x, c) in got.items() if x == g} == want, g
    rest = {r.g: r["round"] for r in model.collect()}
    assert rest["one"] == 1 and rest["same"] == 1 and max(rest.values()) <= C.ROUNDS and len(set(rest.values())) > 1
    assert C.keyed_kmeans(pts.limit(0), 2)[0].count() == 0


def test_starts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(groups(), "id long, g string, v array<double>")
    one = {r.id: r.cluster for r in C.keyed_kmeans(C.points_of(df.coalesce(1), "id", "v", F.col("g")), 3)[0].collect()}
    assert one == {r.id: r.cluster for r in C.keyed_kmeans(C.points_of(df.repartition(7), "id", "v", F.col("g")), 3)[0].collect()}


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(12, 6)) * 5
    v = np.r_[middle[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) * 0.5, rng.normal(size=(6, 6)) * 40]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    members, nodes = C.divisive_tree(df, "id", "v", 25)
    return members, nodes, {r.path: r for r in nodes.collect()}, df


def test_large_nodes_are_split_as_in_a_task(spark, tree):
    members, _, nodes, df = tree
    other, table = C.divisive_tree(df, "id", "v", 25, task_points=130)
    assert {r.path: tuple(r) for r in table.collect()} == {p: tuple(r) for p, r in nodes.items()}
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, members.collect()))


def test_tree_is_consistent(tree):
    members, _, nodes, _ = tree
    paths = [r.path for r in members.collect()]
    assert len(paths) == 506
    for p, r in nodes.items():
        assert sum(x.startswith(p) for x in paths) == r["size"]
        if r["left"] is not None:
            assert (nodes[p + "0"]["size"], nodes[p + "1"]["size"]) == (r["left"], r["right"])


def plain_cut(paths, nodes, m, size):
    def end(p):
        for k in range(len(p) + 1):
            r = nodes[p[:k]]
            if r["left"] is None or r["size"] < size or max(r["left"], r["right"]) < m:
                return p[:k]
        return p
    return [end(p) for p in paths]


def test_cut_counts_are_monotone_and_reach_the_target(tree):
    members, table, nodes, _ = tree
    rows = members.collect()
    for m in (5, 3):
        counts = []
        for size in sorted({r["size"] for r in nodes.values()}, reverse=True)[:20]:
            cut = plain_cut([r.path for r in rows], nodes, m, size)
            topics = {p for p in cut if cut.count(p) >= m}
            counts.append(len(topics) + any(cut.count(p) < m for p in set(cut)))
            assert C.topics_at(table, m, size) == counts[-1]
        assert counts == sorted(counts)
    m, size = C.choose_cut(table, 25)
    assert m == 5 and C.topics_at(table, m, size) >= 25
    got = {r.id: r.path for r in C.cut_tree(members, table, m, size).collect()}
    assert got == dict(zip([r.id for r in rows], plain_cut([r.path for r in rows], nodes, m, size), strict=True))
    assert C.choose_cut(table, 10**6) == (2, 0)


def test_identical_points_are_not_split(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "id long, v array<double>")
    members, nodes = C.divisive_tree(df, "id", "v", 4)
    assert nodes.count() == 1 and members.select("path").distinct().collect()[0].path == "" and C.choose_cut(nodes, 4) == (2, 0)
    empty, none = C.divisive_tree(df.limit(0), "id", "v", 4)
    assert empty.count() == 0 and none.count() == 0


def test_svd_subspace(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{t}w{k}" for k in range(40)] for t in range(6)]
    texts = [" ".join(rng.choice(topics[rng.integers(6)], 30)) for _ in range(300)] + ["", "a b", None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, journal_story string, h string")
    hashed = df.select("id", E.term_hashes("journal_story", 512).alias("_hashes"))
    idf, v = E.fit_svd(hashed, 6, 512)
    a = np.zeros((len(texts), 512))
    for r in hashed.collect():
        for t in r._hashes:
            a[r.id, t] += 1
    n_docs = (a > 0).sum(0)
    assert np.allclose(idf, np.log((len(texts) + 1) / (n_docs + 1)))
    a *= idf
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    angles = np.linalg.svd(vt[:6] @ v, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9) and angles.min() > 0.98, (angles, s[:9])
    out = {r.id: r for r in E.embed(df, "journal_story", 6, 512).collect()}
    want = a @ v
    for k in (0, 7, 299):
        assert np.allclose(out[k].vector, want[k] / np.linalg.norm(want[k]), atol=1e-9)
    assert out[300].vector == [0.0] * 6 and out[302].h == "x" and len(out) == 303


def plain_log(topics, floor=None):
    """Always merge the most similar pair of all, by average linkage over the topics."""
    unit = {t: np.array(v) / np.linalg.norm(v) for t, _, _, v in topics}
    live = {t: (n, f, [(t, n)]) for t, n, f, _ in topics}
    log = []
    while len(live) > 1:
        mean = {t: sum(w * unit[x] for x, w in own) / n for t, (n, _, own) in live.items()}
        s, a, b = min((-float(mean[a] @ mean[b]), a, b) for a in live for b in live if a < b)
        if floor is not None and -s < floor:
            break
        x, y = sorted((a, b), key=lambda t: (-live[t][0], live[t][1], t))
        log.append((y, x, -s))
        (n1, f1, o1), (n2, f2, o2) = live[x], live.pop(y)
        live[x] = (n1 + n2, min(f1, f2), o1 + o2)
    return log


@pytest.mark.parametrize("n,block", [(1, 4), (2, 1), (40, 7), (140, 512)])
def test_merge_log_equals_the_plain_loop(spark, n, block):
    rng = np.random.default_rng(n)
    topics = [(t, int(rng.integers(1, 9)), 100 - t, rng.normal(size=5).tolist()) for t in range(n)]
    df = spark.createDataFrame(topics, "topic int, size long, first long, centroid array<double>")
    for floor in (None, 0.4) if n > 99 else (None,):
        got = [(r.topic, r.into, r.similarity) for r in M.merge_log(df, floor, block).orderBy("step").collect()]
        want = plain_log(topics, floor)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    if n > 99:
        ends = {r.topic: r._into for r in M.final_topics(M.merge_log(df), 90).collect()}
        to = {t: i for t, i, _ in plain_log(topics)[:90]}
        for t, i in to.items():
            while i in to:
                i = to[i]
            assert ends[t] == i


def test_equal_topics_merge_in_a_fixed_order(spark):
    topics = [(t, 1, t, [1.0, 0.0]) for t in range(6)] + [(6, 2, 9, [0.0, 1.0])]
    df = spark.createDataFrame(topics, "topic int, size long, first long, centroid array<double>")
    log = M.merge_log(df).collect()
    assert len(log) == 6 and {r.topic for r in log if r.similarity > 0.9} == {1, 2, 3, 4, 5}
    assert len(M.merge_log(df, block=3).collect()) == 6
