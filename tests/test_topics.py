"""Contract tests for the model-based operators (no library parity)."""

from pyspark.sql import functions as F

from trailspark.operators import language as L
from trailspark.operators import merging as M
from trailspark.operators import topics as T
from trailspark.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_kmeans_topics_contract(spark):
    j = S.journals(spark, SF, with_label=False, columns=["journal_id", "journal_story"])
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    clustered = T.fit_clusters(j, "journal_id", 12)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached + 1  # a checkpoint, no cache left
    lab = T.label_topics(clustered, "journal_id", 3)
    sizes = {r["topic"]: r["n"] for r in lab.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    real = sorted(t for t in sizes if t != -1)
    assert real == list(range(len(real)))                       # dense ids
    assert all(sizes[t] >= 3 for t in real)                      # no topic under min size
    assert [sizes[t] for t in real] == sorted((sizes[t] for t in real), reverse=True)  # ids by size
    assert lab.count() == j.count()                              # every row labelled
    vecs = T.topic_vectors(clustered.join(lab.select("journal_id", "topic"), "journal_id"), "journal_id")
    log = M.merge_log(vecs)
    reduced = T.reduce_topics(lab.select("journal_id", "topic"), log, "journal_id", merges=max(len(real) - 2, 0))
    n_after = sorted(r["topic"] for r in reduced.where("topic != -1").select("topic").distinct().collect())
    assert n_after == list(range(min(2, len(real))))
    assert log.count() == len(real) - 1 and reduced.count() == j.count()
    assert reduced.where("topic = -1").count() == sizes.get(-1, 0)
    three = T.reduce_to(lab.select("journal_id", "topic"), vecs, "journal_id", 3)
    assert three.select("topic").distinct().count() == 3
    auto = M.merge_log(vecs, 0.3).collect()
    assert all(r["similarity"] >= 0.3 for r in auto)
    sim = T.cosine_matrix(vecs)
    diag = [r["similarity"] for r in sim.where("topic_a = topic_b").collect()]
    assert all(abs(d - 1.0) < 1e-9 for d in diag)


def test_language_detection_quality(spark):
    docs = S.read_table(spark, "/root/testdata/sf0.01", "documents", ["doc_id", "text", "lang"])
    train = docs.where(F.col("doc_id") % 2 == 0)
    test = docs.where(F.col("doc_id") % 2 == 1)
    profile, langs = L.train_profile(train)
    pred = L.detect(test, profile, langs).join(test.select("doc_id", "lang"), "doc_id")
    acc = pred.where(F.col("lang_pred") == F.col("lang")).count() / pred.count()
    assert acc >= 0.95


def test_ctfidf_ranks(spark):
    df = spark.createDataFrame([("a", "apple apple pear"), ("a", "apple kiwi"), ("b", "pear pear kiwi")],
                               "cls string, text string")
    w = T.ctfidf(T.term_counts(df, "cls", "text"), "cls", 2)
    top = {(r["cls"], r["rank"]): r["term"] for r in w.collect()}
    assert top[("a", 1)] == "apple" and top[("b", 1)] == "pear"


def test_language_detection_head_tail_and_brute_force(spark, monkeypatch):
    import math
    import random
    from collections import Counter
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    texts = [(" ".join(word(a) for _ in range(rng.randrange(1, 30))), a[0]) for a in ("abcdé", "bcdefz", "日本語字a") for _ in range(12)]
    texts += [(None, "a"), ("", None), ("a", "b"), ("Ab", None), ("  12 ab-c 34 ", None), ("𝒳𝒴 abc", None), ("qqqq", None), ("ÀÉ éa", None)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def grams(t):
        s = " " + " ".join("".join(x if x.isalpha() else " " for x in (t or "").lower()).split()) + " "
        return [s[i:i + 3] for i in range(len(s) - 2)] if len(s) >= 4 else []

    c, d = {}, Counter(lang for _, lang in texts if lang)
    for t, lang in texts:
        if lang:
            c.setdefault(lang, Counter()).update(grams(t))
    v = len(set().union(*c.values()))

    def best(t):
        score = {k: math.log(d[k] / sum(d.values())) + sum(math.log((x[g] + 1) / (sum(x.values()) + v)) for g in grams(t)) for k, x in c.items() if x}
        return max(sorted(score), key=score.get) if grams(t) else None

    want = {i: best(t) for i, t, _ in rows}
    for head, letters in ((L.HEAD_ROWS, L.ARRAY_GRAMS), (40, 8), (0, 8)):
        monkeypatch.setattr(L, "HEAD_ROWS", head)
        monkeypatch.setattr(L, "ARRAY_GRAMS", letters)
        monkeypatch.setattr(L, "SLICE_BYTES", 60)
        found = L.detect(docs, *L.train_profile(docs))
        assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == want
    none = L.detect(docs, *L.train_profile(docs.where("lang = 'none'")))
    assert {r["lang_pred"] for r in none.collect()} == {None} and none.count() == len(rows)


def test_language_detection_does_not_shuffle_texts_or_grams(spark):
    docs = S.read_table(spark, SF, "documents", ["doc_id", "text", "lang"])
    plan = L.detect(docs, *L.train_profile(docs))._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan and "Generate" not in plan


def test_term_counts_by_table_and_by_join(spark, monkeypatch):
    import re
    from collections import Counter

    from trailspark.operators import cleaning as C
    rows = [("a", "The cat sat, the CAT ran"), ("a", None), ("b", "the"), ("b", "Dog the dog x cat"), (None, "cat"), ("b", ""), ("b", "dog")]
    df = spark.createDataFrame(rows, "cls string, text string")
    stop = spark.createDataFrame([("the",), ("Dog",), ("ran",), ("the",)], "word string")
    want, single = Counter(), Counter()
    for c, text in rows:
        t = [x for x in re.findall(r"\w{2,}", (text or "").lower()) if x not in ("the", "ran")]
        if c:
            want.update((c, x) for x in [*t, *map(" ".join, zip(t, t[1:], strict=False))])
            single.update((c, x) for x in t)
    for limit in (C.TABLE_BYTES, 0):
        monkeypatch.setattr(C, "TABLE_BYTES", limit)
        for n, expected in ((1, single), (2, want)):
            assert {(r["cls"], r["term"]): r["tf"] for r in T.term_counts(df, "cls", "text", stop, (1, n)).collect()} == expected


def test_bigrams_are_formed_without_a_shuffle_of_terms(spark):
    from trailspark.plans import registry
    df = registry.QUERIES["term_counts_bigrams"](spark, SF)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in ran and "posexplode(" not in ran


def test_blocks_as_matrices_equal_sorted_rows():
    import numpy as np
    import pyarrow as pa

    from trailspark.operators import embedding as E
    r = np.random.default_rng(0)
    lists = [r.integers(0, 512, n).tolist() * 2 for n in r.integers(90, 200, 50)] + [[], [7], [7, 7, 3]]
    hashes, idf, q = pa.array(lists, pa.list_(pa.int32())).slice(1), r.random(512) + 0.1, r.standard_normal((512, 6))
    dense, sparse = E._rows(hashes, idf), E._Rows(hashes, idf)
    assert isinstance(dense, E._Dense) and isinstance(E._rows(hashes.slice(50), idf), E._Rows)
    y, out, want = dense.times(q), np.ones(q.shape), np.ones(q.shape)
    dense.add_transposed(y, out)
    sparse.add_transposed(sparse.times(q), want)
    assert np.allclose(y, sparse.times(q)) and np.allclose(out, want)


def test_words_of_topics_read_the_texts_once(spark):
    from trailspark.plans import topics as P
    docs = S.journals(spark, SF, with_label=False, columns=["journal_id", "journal_story", "topic"])
    words = P._words(spark, SF, docs)
    assert "regexp_extract_all" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert words.count() == docs.select("topic").distinct().count()
