import hashlib
import zlib

import helpers as H
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailspark.llm import queries, runs


def brute(words, min_words=6, exponent=4):
    """Every maximal stretch of period q, for every q; of one that has a smaller period too, only the smallest counts."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, exponent * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if not smaller:
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    r = runs.find_runs(np.array([numbers[w] for w in words], np.int64), np.zeros(len(words), np.int64))
    return sorted(map(tuple, r.tolist()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=90))
def test_runs_equal_brute_force(words):
    assert found(words) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_planted_powers_equal_brute_force(parts):
    words = [w for block, times in parts for w in block * times]
    assert found(words) == brute(words)


def test_documents_of_a_batch_do_not_touch():
    texts = [[b"a"] * 5, [b"a"] * 5, [], [b"b", b"a"] * 4, [b"a"] * 7]
    assert [r.tolist() for r in runs.runs_of(texts)] == [[], [], [], [[0, 8, 2]], [[0, 7, 1]]]


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), np.zeros(9, np.int64), min_exponent=2)


def test_best_run_is_exact():
    r = np.array([[0, 400_000_001, 100_000_000], [5, 40, 10], [9, 4, 1], [1, 8, 2]])
    assert runs.best_run(r) == (0, 400_000_001, 100_000_000)
    assert runs.best_run(r[1:]) == (1, 8, 2) and runs.best_run(r[:0]) is None


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    r = brute(words)
    gone = {k for s, length, q in r for k in range(s + q, s + length)}
    best = min(r, key=lambda x: (-x[1] * 1_000_000_007 // x[2], x[0], x[2])) if r else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(r), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join("%d,%d,%d\n" % x for x in r).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = H.rng(8)
    texts = H.odd_texts()[:-1] + ["  a a", "the cat sat " * 6 + "down", "x " * 6 + "y " * 6]
    for _ in range(90):
        t = H.words(rng, rng.randrange(0, 60), 30)
        if rng.random() < 0.4 and t:
            k, m = rng.randrange(len(t)), rng.randrange(1, 5)
            t[k:k] = H.words(rng, m, 3) * rng.randrange(2, 8)
        texts.append("\n".join(t) if rng.random() < 0.3 else "  ".join(t))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (None, None), (3, "q " * 9), (3, "q " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(([tuple(r)[0], tuple(r)[1:]] for r in out.collect()), key=str)
    assert got == sorted(([i, expected(i, t)] for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and (t or "").split() for i, t in rows if i is not None)


def test_operator_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, __runs int, period string")
    one, two = runs.detect_runs(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in one["__runs"]] == [(0, 8, 2)] and one["__collapsed"] == "a b c" and one.period == "x"
    assert two["__runs"] == [] and two["__collapsed"] == "" and two.text is None
    assert runs.detect_runs(df.limit(0)).count() == 0


def test_very_long_and_wholly_periodic_text(spark):
    df = spark.createDataFrame([(1, "long " * 300_000), (2, " ".join(map(str, range(300_000))))], "doc_id long, text string")
    rows = {r.doc_id: r for r in runs.detect_runs(df, digest=True).collect()}
    assert tuple(rows[1]["__best"]) == (0, 300_000, 1) and rows[2]["__n_runs"] == 0
    assert runs.detect_runs(df).select(F.length("__collapsed").alias("n")).where("n = 4").count() == 1
