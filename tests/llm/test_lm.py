import math
import re
import zlib
from collections import Counter

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.llm import lm
from trailspark.llm.common import doc_fold


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", H.lower(text or "")), None]


def small_params(n=30, hidden=5):
    r = np.random.default_rng(1)
    p = lm.new_params(r.integers(1, 50, n).astype(float), hidden)
    return {k: (v + r.normal(0, 0.3, v.shape) * (v > -1e8)).astype(np.float64) for k, v in p.items()}


def test_token_probabilities_sum_to_one():
    p = small_params()
    h = np.random.default_rng(2).normal(size=(4, 5))
    total = sum(np.exp(lm.token_log(p, h, np.full(4, t))[0]) for t in range(30))
    assert np.allclose(total, 1)


def test_gradients_equal_differences():
    p = small_params(12, 4)
    r = np.random.default_rng(3)
    tok, tgt = r.integers(0, 12, (6, 3)), r.integers(0, 12, (6, 3))
    tok[0] = 12

    def loss(q):
        h, total = np.zeros((3, 4)), 0.0
        for t in range(6):
            h, _ = lm.gru_step(q, h, tok[t], 12)
            total -= lm.token_log(q, h, tgt[t])[0].sum()
        return total

    got = {}

    class Probe(lm.Trainer):
        pass

    trainer = Probe({k: v.copy() for k, v in p.items()}, 0.0)
    trainer.window(np.zeros((3, 4)), tok, tgt, 12)
    # after one step the first moment is a tenth of the (scaled) gradient
    got = {k: v / 0.1 for k, v in trainer.m.items()}
    want = {}
    for k in ("u", "b", "wc", "bw", "ww", "x"):
        flat, g = p[k].reshape(-1), []
        for i in r.choice(flat.size, 5, replace=False):
            old = flat[i]
            if old < -1e8:
                continue
            flat[i] = old + 1e-5
            up = loss(p)
            flat[i] = old - 1e-5
            down = loss(p)
            flat[i] = old
            g.append(((up - down) / 2e-5, got[k].reshape(-1)[i]))
        want[k] = g
    pairs = np.array([x for g in want.values() for x in g])
    scale = (pairs[:, 0] @ pairs[:, 1]) / (pairs[:, 0] @ pairs[:, 0])
    assert np.allclose(pairs[:, 1], scale * pairs[:, 0], atol=1e-3 * np.abs(pairs[:, 1]).max() + 1e-7)


@pytest.mark.parametrize(("lanes", "window"), [(1, 1000), (3, 4), (256, 64)])
def test_windows_and_lanes_do_not_change_scores(lanes, window):
    p = small_params()
    r = np.random.default_rng(5)
    texts = [np.append(r.integers(1, 30, k), 0) for k in (0, 1, 5, 40, 17, 3, 90)]

    def alone(t):
        h, total = np.zeros((1, 5)), 0.0
        for x, y in zip([30, *t[:-1]], t, strict=True):
            h, _ = lm.gru_step(p, h, np.array([x]), 30)
            total += lm.token_log(p, h, np.array([y]))[0][0]
        return total

    assert np.allclose(lm.score_texts(p, texts, lanes, window), [alone(t) for t in texts], atol=1e-3)


@pytest.mark.parametrize("head", [400_000, 40])
def test_counts_and_base_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "LM_WORDS", 25)
    rng = H.rng()
    texts = [" ".join(H.words(rng, rng.randrange(1, 60), 90)) for _ in range(120)] + H.odd_texts()
    docs = H.documents(spark, texts).select("doc_id", "text", F.lit(7).alias("n_tokens"))
    train = docs.where(doc_fold(folds=10) != 0)
    counts = lm.count_words(train, head_words=head)
    rows = {r.doc_id: r for r in lm.score(docs, counts, lm.fit(train, counts)).collect()}
    c = Counter(t for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert (counts.n_tokens, counts.n_types) == (n, v) and len(rows) == len(texts) and len(counts.head) <= head
    for i, x in enumerate(texts):
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))
        assert (rows[i].n_tokens, rows[i].n_known) == (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)))
        assert math.isclose(rows[i].base_score, base, rel_tol=1e-9) and rows[i].score < 0


def test_model_beats_the_base_on_unseen_texts(spark):
    rng = H.rng(4)

    def text():  # two registers that do not mix
        k = rng.randrange(2)
        return " ".join(f"{'ab'[k]}{rng.randrange(40)}" for _ in range(rng.randrange(20, 80)))

    docs = H.documents(spark, [text() for _ in range(400)]).select("doc_id", "text")
    train = docs.where(doc_fold(folds=10) != 0)
    counts = lm.count_words(train)
    model = lm.fit(train, counts, share=1.0, rates=(0.02, 0.01, 0.004))  # there are 20,000 words in all
    held = lm.score(docs.where(doc_fold(folds=10) == 0), counts, model).collect()
    assert sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, None), (0, None), (1, "a")], "doc_id long, text string")
    counts = lm.count_words(docs.limit(0))
    rows = lm.score(docs, counts, lm.fit(docs.limit(0), counts)).collect()
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in rows) == [(1, 0, 0.0, 0.0)] * 2 + [(2, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), counts, lm.fit(docs.limit(0), counts)).count() == 0


def test_sample_is_one_share_of_rows_and_tasks_add_up(spark, monkeypatch):
    rng = H.rng(12)
    texts = [" ".join(H.words(rng, 40, 60)) for _ in range(1500)]
    docs = spark.createDataFrame([(None if k % 3 == 0 else k % 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = lm.count_words(docs)
    written, plain = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df: written.append(plain(df)) or written[-1])
    for n, share in ((1500, 0.2), (300, 0.2)):
        written.clear()
        lm.fit(docs.limit(n), counts, share=share)
        assert abs(written[0].count() - share * n) < 5 * (share * (1 - share) * n) ** 0.5  # null and repeated ids are rows like others
    monkeypatch.setattr(lm, "PART_TOKENS", 1000)
    monkeypatch.setattr(lm, "FAN_IN", 3)
    written.clear()
    model = lm.fit(docs, counts, share=0.2)
    tokens = sum(len(bytes(r.ids)) // 4 for r in written[0].collect())
    sums = written[1:]
    assert len(sums) == 3 and sums[0].count() > 9  # about 12 tasks, then 4, 2 and 1
    totals = [sum(r.n for r in t.collect()) for t in sums]
    assert totals == [tokens] * 3
    flat = sum(np.frombuffer(bytes(r.p), np.float64) for r in sums[0].collect()) / tokens
    assert np.allclose(flat, np.concatenate([model.params[k].ravel() for k in sorted(model.params)]), rtol=1e-5, atol=1e-6)


def test_long_texts_are_learned_from_whole():
    seen = []

    class Probe(lm.Trainer):
        def window(self, h, tokens, target, start, inside=None):
            seen.extend(target[inside].tolist())
            return h

    p = lm.new_params(np.ones(30))
    r = np.random.default_rng(6)
    texts = [np.append(r.integers(2, 30, n), 0) for n in (0, 3, 2000, 700, 41)]
    Probe(p, 0.01).texts(texts, lanes=4, window=24)
    assert sorted(seen) == sorted(np.concatenate(texts).tolist())


def test_network_learns_from_every_training_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 500)  # several tasks, whose parameters are averaged
    rng = H.rng(6)
    docs = H.documents(spark, [" ".join(H.words(rng, rng.randrange(1, 60), 90)) for _ in range(120)] + H.odd_texts()).select("doc_id", "text")
    train = docs.where(doc_fold(folds=10) != 0)
    counts = lm.count_words(train)
    assert lm.fit(train, counts).learned == counts.n_tokens


def test_frequent_words_share_their_class_with_few():
    """What a token costs: the classes and the words of its own class, 90 on average with classes of one width."""
    first = lm.classes(2002)
    assert first[0] == 0 and first[-1] == 2002 and (np.diff(first) > 0).all()
    ids = np.arange(2002)
    assert (lm.class_of(ids) == np.searchsorted(first, ids, "right") - 1).all()
    mass = 1 / (ids + 2.7)
    width = np.diff(first)
    assert len(width) + np.add.reduceat(mass / mass.sum(), first[:-1]) @ width < 75
    for n in (1, 2, 4, 5, 30):
        p = lm.new_params(np.ones(n), 3)
        h = np.zeros((2, 3), np.float32)
        assert np.isclose(sum(np.exp(lm.token_log(p, h, np.full(2, t))[0]) for t in range(n)), 1).all()


def test_large_weights_neither_overflow_nor_vanish():
    p = {k: v * np.where(k in ("wc", "ww"), 4000.0, 1.0) for k, v in small_params().items()}
    h = np.random.default_rng(2).uniform(-1, 1, size=(40, 5))
    log, dh = lm.token_log(p, h, np.arange(40) % 30, {k: np.zeros_like(v) for k, v in p.items()})
    assert np.isfinite(log).all() and np.isfinite(dh).all()


def test_words_of_batches_equal_those_of_single_texts():
    import pyarrow as pa
    texts = ["", None, " a\tB\x0bb\x0c\r ", "ÉA  x\x1cy", "\n", "one", *H.odd_texts(), None]
    words, n = lm.words_in(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    want = [[w.encode() for w in tokens(t)[:-1]] for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [w for t in want for w in t]
    assert lm.places(pa.array([b"b", b"", b"a"]), pa.array([b"a", b"b"])).tolist() == [1, -1, 0]
    ids, ends = lm.with_ends(np.array([7, 8, 9], np.int32), np.array([2, 0, 1, 0]))
    assert ids.tolist() == [7, 8, 0, 0, 9, 0, 0] and ends.tolist() == [3, 4, 6, 7]


def test_states_are_made_without_arrays_of_all_gates():
    """Gates of a whole window, six times its states, cost more to fetch and clear than to compute."""
    import tracemalloc
    p = lm.new_params(np.ones(30))
    tokens = np.random.default_rng(7).integers(0, 30, (64, 256))
    h = np.zeros((256, lm.HIDDEN), np.float32)
    size = 4 * 64 * 256 * lm.HIDDEN
    tracemalloc.start()
    lm.gru_states(p, h, tokens, 30)
    assert tracemalloc.get_traced_memory()[1] < 2 * size
    tape = {}
    first = lm.gru_states(p, h, tokens, 30, tape)
    held = {k: id(v) for k, v in tape.items()}
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    again = lm.gru_states(p, h, tokens, 30, tape)
    assert tracemalloc.get_traced_memory()[1] - before < 2 * size  # the tape's arrays serve the next window too
    tracemalloc.stop()
    assert {k: id(v) for k, v in tape.items()} == held and np.array_equal(first, again)
    lm.gru_states(p, h[:100], tokens[:5, :100], 30, tape)
    assert tape["prev"].shape == (5, lm.HIDDEN, 100)


def test_rows_are_summed_by_token():
    r = np.random.default_rng(8)
    tokens = np.concatenate([np.repeat([1, 0], [500, 40]), r.integers(2, 60, 200), [70], np.repeat([71, 72], [lm.FEW, lm.FEW + 1])])
    r.shuffle(tokens)
    for some in (tokens, tokens[:1], np.full(3, 5)):
        rows = r.normal(size=(len(some), 6))
        want = np.zeros((80, 6))
        np.add.at(want, some, rows)
        token, sums = lm.sums_by_token(rows, some)
        assert token.tolist() == sorted(set(some.tolist())) and np.allclose(sums, want[token])


def test_full_gates_give_finite_states_and_gradients():
    import warnings
    for dtype in (np.float32, np.float64):
        p = {k: (v * (1e5 if k == "x" else 1)).astype(dtype) for k, v in small_params().items()}
        tokens = np.random.default_rng(9).integers(0, 31, (7, 4))
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            states = lm.gru_states(p, np.zeros((4, 5), dtype), tokens, 30)
            trainer = lm.Trainer({k: v.copy() for k, v in p.items()}, 0.01)
            trainer.window(np.zeros((4, 5), dtype), tokens, tokens % 30, 30)
        assert np.isfinite(states).all() and np.abs(states).max() <= 1 and np.isfinite(trainer.flat).all()
