import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.llm import mixing

MARGINS = ["__source", "__lang", "__topic"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = H.rng(6)
    texts = [" ".join(rng.choice(["thing", "onion", "chen", "oui", "cios", "zz"]) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    langs = [rng.choice(["en", "en", "en", "de", None]) for _ in texts]
    sources = ["src0" if k % 3 == 0 else f"src{rng.randrange(1, 6)}" for k in range(len(texts))]
    df = H.documents(spark, texts + H.odd_texts(), langs + [None] * len(H.odd_texts()), sources + [None] * len(H.odd_texts()))
    return df.select("doc_id", F.lit("x").alias("weight"), *[c.alias(k) for k, c in mixing.features(df).items()])


@pytest.mark.parametrize("local", [100_000, 0])
def test_margins_meet_their_targets(spark, docs, local):
    cells = docs.groupBy(*MARGINS).agg(F.sum("__tokens").alias("tokens"))
    targets = {m: mixing.tempered(cells, m) for m in MARGINS}
    fitted = mixing.rake(cells, targets, rounds=12 if local == 0 else 40, max_local=local)
    for m, t in targets.items():
        want = {r[0]: r[1] for r in t.collect()}
        got = {r[0]: r[1] for r in fitted.groupBy(m).agg(F.sum("fit")).collect()}
        for k, x in got.items():
            assert abs(x - want[k]) < (0.02 if local == 0 else 1e-6), (m, k)


def test_given_targets_and_the_kept_share(spark, docs):
    even = {m: docs.select(m).distinct().withColumn("target", F.lit(1.0) / docs.select(m).distinct().count()) for m in MARGINS}
    for kw in ({}, {"targets": even}, {"keep": 0.1}):
        rows = mixing.mix(docs, **kw).collect()
        t, p = np.array([r["__tokens"] for r in rows]), np.array([r["__probability"] for r in rows])
        assert len(rows) == docs.count() and ((p >= 0) & (p <= 1)).all() and {r.weight for r in rows} == {"x"}
        assert abs((t * p).sum() - kw.get("keep", mixing.KEEP) * t.sum()) < 1e-6 * t.sum()
        assert all(r["__sampled"] == (r["__draw"] < r["__probability"]) for r in rows)


def unit(doc_id, text):
    import hashlib
    whole = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}/{whole}".encode()).hexdigest()[:13], 16) / 2 ** 52


def test_rows_are_drawn_by_id_and_text(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, "b"), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("u", mixing.unit_hash())
    got = [r.u for r in df.collect()]
    assert got == [unit(i, t) for i, t in rows] and len(set(got)) == 6


def odd_corpus(spark):
    """A third of the rows without an id, a third under seven ids; words of one kind, so that cells are (source, language)."""
    rng = H.rng(21)
    rows = []
    for k in range(2040):
        doc_id = None if k % 3 == 0 else k % 7 if k % 3 == 1 else k
        lang = "en" if rng.random() < 0.8 else "fr"
        rows.append((doc_id, "zz " * 20 + str(k), lang, "src", 0))
    return spark.createDataFrame(rows, H.DOCS)


def test_null_and_repeated_ids_are_sampled_row_by_row(spark):
    df = odd_corpus(spark)
    rows = mixing.mix(df.withColumns(mixing.features(df)).withColumn("weight", F.lit("kept"))).collect()
    assert len(rows) == 2040 and {r.weight for r in rows} == {"kept"}
    for part in (lambda i: i is None, lambda i: i is not None and i < 7, lambda i: i is not None and i >= 7):
        for lang in ("en", "fr"):
            own = [r for r in rows if part(r.doc_id) and r.lang == lang]
            share, p = sum(r["__sampled"] for r in own) / len(own), own[0]["__probability"]
            assert abs(share - p) < 4.5 * (p * (1 - p) / len(own)) ** 0.5 + 1e-9, (lang, share, p)


def test_pipeline_keeps_the_sampled_rows_without_shuffling_texts(spark):
    import corpus_pipeline
    df = odd_corpus(spark)
    want = sorted((r.text for r in mixing.mix(df.withColumns(mixing.features(df))).collect() if r["__sampled"]))
    kept = corpus_pipeline.mixture(spark, df, "")
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_sampling_rate_against_bisection(spark):
    rng = H.rng(8)
    many = [(rng.randrange(1, 900), rng.random() ** 6 + 1e-4) for _ in range(300)]
    for rows in ([(100, 4.0), (300, 1.0), (600, 0.2), (50, 0.0)], many):
        cells = spark.createDataFrame(rows, "tokens long, weight double")
        for keep in (0.05, 0.3, 0.6, 1.0):
            goal, low, high = keep * sum(t for t, _ in rows), 0.0, 1 / min(w for _, w in rows if w)
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(t * min(1, w * mid) for t, w in rows) < goal else (low, mid)
            assert abs(mixing.sampling_rate(cells, keep) - high) < 1e-9 * high
    assert mixing.sampling_rate(cells.limit(0)) == 0


@pytest.mark.parametrize("local", [100_000, 0])
def test_raking_ends_when_all_margins_hold(spark, local, monkeypatch):
    cells = spark.createDataFrame([(a, b, 3 ** a * 2 ** b) for a in range(4) for b in range(3)], "a long, b long, tokens long")
    even = {m: spark.range(n).select(F.col("id").alias(m), F.lit(1.0 / n).alias("target")) for m, n in (("a", 4), ("b", 3))}
    written = []
    monkeypatch.setattr(mixing, "materialize", lambda df: written.append(1) or df.cache())
    fitted = mixing.rake(cells, even, max_local=local)
    # independent margins hold after the first round, the second sees it: one table for the cells, one a round
    assert len(written) == (1 if local else 3)
    assert max(r.error for r in mixing.margin_errors(fitted, even).collect()) < 1e-12
    # no tokens for a target: it can't be met, and what is left is told
    short = mixing.rake(cells.where("a < 3"), even, max_local=100_000)
    errors = {r.margin: r.error for r in mixing.margin_errors(short, even).collect()}
    assert abs(errors["a"] - 0.25) < 1e-9


def test_topics_and_tokens(spark):
    df = H.documents(spark, ["th th on", "on", None, "", "on th", "zzz\tq"])
    rows = df.select(mixing.topic_of().alias("t"), mixing.token_count().alias("n")).collect()
    assert [tuple(r) for r in rows] == [("b", 3), ("a", 1), ("none", 0), ("none", 0), ("a", 2), ("none", 2)]


def test_no_rows_and_no_tokens(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    rows = mixing.mix(docs.where("__tokens = 0")).collect()
    assert rows and not any(r["__sampled"] for r in rows)
