import helpers as H
import numpy as np
from pyspark.sql import functions as F

from trailspark.llm import toxicity
from trailspark.llm.decontaminate import words_of

BAD = ["stupidone", "wretchling", "scumbagger"]


def corpus(n=400):
    rng = H.rng(2)
    texts, toxic = [], []
    for k in range(n):
        w = H.words(rng, rng.randrange(10, 120), 5000)
        bad = k % 4 == 0
        if bad:
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_and_misspellings(spark):
    texts, toxic = corpus()
    docs = H.documents(spark, texts + H.odd_texts()).withColumn("score", F.lit("kept"))
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(F.coalesce(F.col("doc_id") % 3, F.lit(0)) != 1))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + len(H.odd_texts()) and all(0 <= r["__toxicity"] <= 1 and r.score == "kept" for r in rows)
    held = [r for r in rows if r.doc_id < len(texts) and r.doc_id % 3 == 1]
    hit = np.array([r["__toxicity"] >= 0.7 for r in held])
    y = np.array([toxic[r.doc_id] for r in held])
    assert hit[y == 1].mean() > 0.9 and hit[y == 0].mean() < 0.05
    clean = [w for t, x in zip(texts, toxic, strict=True) if not x for w in t.split()][:300]
    assert model.word(b"stupidonee") > max(model.word(w.encode()) for w in clean[:50])
    long = " ".join(clean * 20 + ["wretchling"] + clean)  # one word in thousands
    assert model.score(words_of(long.encode()), {}) > model.score(words_of(" ".join(clean).encode()), {})


def test_one_class_no_rows_and_bags(spark):
    docs = H.documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r["__toxicity"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    for n in (0, 1, 7, 8, 11, 12, 100):
        at = toxicity.bag_starts(n)
        assert at[0] == 0 and (np.diff(np.append(at, n)) > 0).all() | (n == 0)


def test_long_texts_are_read_whole(spark):
    texts, toxic = corpus()
    words = [w for t, y in zip(texts, toxic, strict=True) if not y for w in t.split()]
    head = spark.range(10_000, 20_000).orderBy(F.xxhash64("id")).first().id
    rows = [(head, " ".join(words * 4), 0), *[(k, t, y) for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").where("doc_id % 3 <> 1 or doc_id >= 10000")
    read, plain = [], toxicity.train
    model = toxicity.fit(docs, labels)
    held = [(model.score(words_of(t.encode()), {}) >= 0.7, y) for k, (t, y) in enumerate(zip(texts, toxic, strict=True)) if k % 3 == 1]
    assert np.mean([hit for hit, y in held if y]) > 0.9 and np.mean([hit for hit, y in held if not y]) < 0.05
    toxicity.train, keep = (lambda t, y: read.append((t, y)) or plain(t, y, steps=1)), toxicity.train
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = keep
    assert sorted(map(len, read[0][0].ids)) == sorted(len(t.split()) for i, t, _ in rows if i % 3 != 1 or i >= 10000)


def test_rows_are_bounded_not_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", {1: 40, 0: 60})
    docs = spark.range(3000).select((F.col("id") % 6).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(k, int(k < 2)) for k in range(6)] * 2, "doc_id long, toxic int")  # repeated labels
    n = {r["__y"]: r["count"] for r in toxicity.sample(docs, labels, "doc_id", "toxic", "text").groupBy("__y").count().collect()}
    assert abs(n[1] - 40) < 30 and abs(n[0] - 60) < 38


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    words = [b"w%d" % k for k in range(30)]
    texts = toxicity.Encoded([[words[i] for i in rng.integers(0, 30, n)] for n in (1, 2, 3, 8, 15, 4)])
    y = np.array([1, 0, 1, 0, 0, 1.0])
    parts = [np.array(toxicity.subwords(w), np.int32) for w in texts.vocab]
    used = np.unique(np.concatenate(parts))
    row_of = np.full(toxicity.BUCKETS, -1, np.int32)
    row_of[used] = np.arange(len(used))
    fold = toxicity._Fold(texts.ids, y, parts, row_of)
    value, bias, sharp = rng.normal(0, 1, len(used)), 0.3, 0.0

    def loss(v, b):  # with a sharpness of zero a text's score is the mean of its bags
        total = 0.0
        for t, c, weight in zip(texts.ids, y, fold.weight, strict=True):
            per_word = [np.mean([v[row_of[i]] for i in parts[w]]) for w in t]
            at = [*toxicity.bag_starts(len(t)), len(t)]
            z = np.mean([np.mean(per_word[i:j]) for i, j in zip(at, at[1:], strict=False)]) + b
            total += weight * (np.log1p(np.exp(z)) - c * z)
        return total

    got, got_bias = fold.gradient(value, bias, sharp, len(used))
    for i in rng.choice(len(used), 12, replace=False):
        up, down = value.copy(), value.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert np.isclose((loss(up, bias) - loss(down, bias)) / 2e-5, got[i], atol=1e-5)
    assert np.isclose((loss(value, bias + 1e-5) - loss(value, bias - 1e-5)) / 2e-5, got_bias, atol=1e-6)
