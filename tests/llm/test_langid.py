import helpers as H
import numpy as np
from pyspark.sql import functions as F

from trailspark.llm import langid

SYLLABLES = {"aa": "ba ke lo mi nu", "bb": "tra scho üng zen ach", "cc": "zwi qua ñol ría ész"}


def text(rng, lang, n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=60):
    rng = H.rng()
    langs = [list(SYLLABLES)[k % 3] for k in range(n)]
    return [text(rng, x, rng.randrange(3, 90)) for x in langs], langs


def test_held_out_accuracy_and_undetermined(spark):
    texts, langs = corpus(150)
    odd = H.odd_texts()
    docs = H.documents(spark, texts + odd, langs + [None] * len(odd)).withColumn("__other", F.lit(1))
    model = langid.fit(docs.where(~langid.held_out()))
    assert model.langs == ["aa", "bb", "cc"]
    rows = langid.classify(docs, model).withColumn("h", langid.held_out()).collect()
    held = [r for r in rows if r.h and r.lang]
    assert len(rows) == len(texts) + len(odd) and np.mean([r["__lang_pred"] == r.lang for r in held]) > 0.95
    for r in rows:
        assert 0 <= r["__lang_score"] <= 1
        assert (r["__lang_pred"] == "und") == (not any(c.isalpha() for c in r.text or "")) and r["__other"] == 1


def test_ngrams_are_of_whole_texts(monkeypatch):
    seen = np.zeros(1 << langid.HASH_BITS, bool)
    t = "Abc déf  ghi--jkl " * 50 + "ßtail"
    whole = langid.ngrams(t, seen)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.ngrams(t, seen) >= 0).all() and set(whole) <= set(langid.ngrams(t, seen)) and not seen.any()
    assert set(langid.ngrams("ab", seen)) < set(langid.ngrams("abc ab", seen))


def test_kernel_scores_equal_the_kernel_written_out(spark):
    texts, langs = corpus(30)
    docs = H.documents(spark, texts, langs)
    model = langid.fit(docs, landmarks=5)
    seen = np.zeros(1 << langid.HASH_BITS, bool)
    sets = [langid.ngrams(t, seen) for t in texts]
    got = model.scores(sets)
    one = model.scores(sets[:1])
    assert np.allclose(got[:1], one, atol=1e-5) and got.shape == (30, 3)
    presence = [sum(model.weights[model.column[g]] for g in s if model.column[g] >= 0) / np.sqrt(len(s)) + model.bias for s in sets]
    assert np.allclose(presence, got, atol=1e-3)


def test_nothing_to_learn_from(spark):
    docs = H.documents(spark, ["abc", None], [None, "en"])
    rows = langid.classify(docs, langid.fit(docs)).collect()
    assert [(r["__lang_pred"], r["__lang_score"]) for r in rows] == [("und", 0.0)] * 2
    assert langid.classify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
