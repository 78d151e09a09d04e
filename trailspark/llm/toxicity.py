"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of itself and its character n-grams (hashed into ``BUCKETS``
rows), a bag is the mean of its words, and two classes are scored by a softmax; vectors
and weights are trained jointly in numpy.  A misspelling never seen shares n-gram vectors with
the words it resembles.  A text is read as bags of ``BAG`` consecutive words, all of them, and
scored by its highest bag, so that a few words weigh the same in a short and in a very long text.
Training moves from the mean of a text's bags to its highest one (a softmax over bags that sharpens).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import map_texts, materialize, text_bytes
from trailspark.llm.decontaminate import words_of

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
BAG = 2
# The fit learns from about so many labelled rows of each class at most, whole texts of any length.
TRAIN_DOCS = {1: 1200, 0: 2400}
# Subwords of fewer training texts get no vector.
MIN_TEXTS = 3
STEPS = 120
RATE = 60.0
DECAY = 2e-5
MOMENTUM = 0.9
FOLDS = 4
SHARPNESS = 4.0
CACHE = 400_000


def subwords(word: bytes) -> list[int]:
    """Rows of a word's own vector and of its n-grams (bytes, with boundary marks)."""
    w = b"<" + word + b">"
    return [zlib.crc32(w) % BUCKETS, *[zlib.crc32(w[i:i + n]) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)]]


def bag_starts(n: int) -> np.ndarray:
    """First words of the bags; a short remainder joins the last bag."""
    return np.arange(max(1, (n + BAG // 2) // BAG)) * BAG


@dataclass
class Model:
    rows: np.ndarray  # a subword's vector times the difference of the class weights
    bias: float

    def word(self, word: bytes) -> float:
        at = subwords(word)
        return float(self.rows[at].sum()) / len(at)

    def score(self, words: list[bytes], cache: dict[bytes, float]) -> float:
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.word(w)
        values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        at = bag_starts(len(words))
        mean = np.add.reduceat(values, at) / np.diff(np.append(at, len(words)))
        return float(1 / (1 + np.exp(-np.clip(mean.max() + self.bias, -50, 50))))


class _Fold:
    """Texts of one gradient step as flat arrays over words, bags and subwords."""

    def __init__(self, ids: list[np.ndarray], y: np.ndarray, parts: list[np.ndarray], row_of: np.ndarray):
        bags = [np.split(t, bag_starts(len(t))[1:]) for t in ids]
        n_bags = np.array([len(b) for b in bags])
        self.first = np.cumsum(n_bags) - n_bags
        self.text_of = np.repeat(np.arange(len(bags), dtype=np.int32), n_bags)
        every = [x for b in bags for x in b]
        self.length = np.array([len(x) for x in every])
        vocab, words = np.unique(np.concatenate(every), return_inverse=True)
        self.words = words.astype(np.int32)
        self.bag_of = np.repeat(np.arange(len(every), dtype=np.int32), self.length)
        self.start = np.cumsum(self.length) - self.length
        own = [parts[w] for w in vocab]
        self.size = np.array([len(p) for p in own])
        rows = row_of[np.concatenate(own)]
        self.flat_word = np.repeat(np.arange(len(own)), self.size)[rows >= 0]
        self.flat = rows[rows >= 0]
        self.y, self.weight = y, np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def gradient(self, row_value: np.ndarray, bias: float, sharp: float, n_rows: int) -> tuple[np.ndarray, float]:
        """Multiples of the class difference per subword, and the gradient of the bias."""
        n = len(self.size)
        value = np.bincount(self.flat_word, weights=row_value[self.flat], minlength=n) / self.size
        z = np.add.reduceat(value[self.words], self.start) / self.length
        e = np.exp(sharp * (z - np.maximum.reduceat(z, self.first)[self.text_of]))
        q = e / np.add.reduceat(e, self.first)[self.text_of]
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(q * z, self.first) + bias, -40, 40)))
        error = (p - self.y) * self.weight
        per_word = np.bincount(self.words, weights=(q * error[self.text_of] / self.length)[self.bag_of], minlength=n) / self.size
        return np.bincount(self.flat, weights=per_word[self.flat_word], minlength=n_rows).astype(np.float32), float(error.sum())


class Encoded:
    """Texts as arrays of word numbers, four bytes a word."""

    def __init__(self, texts: Iterable[list[bytes]] = ()):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        for t in texts:
            self.add(t)

    def add(self, words: list[bytes]) -> None:
        number = self.vocab.setdefault
        self.ids.append(np.fromiter((number(w, len(self.vocab)) for w in words or [b""]), np.int32, max(1, len(words))))


def train(texts: Encoded, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Gradient descent with momentum on ``FOLDS`` parts of the texts in turn; the two classes weigh the same.

    With two classes the softmax depends on the difference ``u`` of the class weights, so the gradient
    of a bag's mean vector is a multiple of ``u`` and one number per bag, word and subword is enough.
    """
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    ids = texts.ids
    parts = [np.array(subwords(w), np.int32) for w in texts.vocab]
    texts_of = np.zeros(BUCKETS, np.int32)
    for t in ids:
        texts_of[np.unique(np.concatenate([parts[i] for i in np.unique(t)]))] += 1
    kept = np.flatnonzero(texts_of >= MIN_TEXTS)
    row_of = np.full(BUCKETS, -1, np.int32)
    row_of[kept] = np.arange(len(kept))
    order = rng.permutation(len(ids))
    folds = [_Fold([ids[i] for i in order[k::FOLDS]], labels[order[k::FOLDS]].astype(float), parts, row_of)
             for k in range(min(FOLDS, len(ids))) if 0 < labels[order[k::FOLDS]].mean() < 1]
    folds = folds or [_Fold(ids, labels.astype(float), parts, row_of)]
    vectors = rng.normal(0, 0.05, (len(kept), DIM)).astype(np.float32)
    u = rng.normal(0, 1, DIM).astype(np.float32)
    u /= np.linalg.norm(u)
    bias = 0.0
    m_vectors, m_u, m_bias = np.zeros_like(vectors), np.zeros_like(u), 0.0
    for step in range(steps):
        a, error = folds[step % len(folds)].gradient(vectors @ u, bias, SHARPNESS * min(1.0, 2 * step / steps), len(kept))
        m_vectors = MOMENTUM * m_vectors + a[:, None] * u + np.float32(DECAY) * vectors
        m_u = MOMENTUM * m_u + vectors.T @ a + np.float32(DECAY) * u
        m_bias = MOMENTUM * m_bias + error
        vectors -= np.float32(RATE) * m_vectors
        u -= np.float32(0.02 * RATE) * m_u
        bias -= 0.02 * RATE * m_bias
    rows = np.zeros(BUCKETS, np.float32)
    rows[kept] = vectors @ u
    return Model(rows, float(bias))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, text: str) -> DataFrame:
    """A bounded sample of labelled rows: about TRAIN_DOCS of each class at most, drawn by a hash of id and text.

    Rows are bounded, not ids: an id that comes with many texts brings no more rows than others.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(
        F.max(label).cast("int").alias("__y"))  # rows that contradict each other count as toxic
    rows = docs.select(F.col(doc_id).alias("__id"), text_bytes(text).alias("__t"))
    counts = {r["__y"]: r["count"] for r in rows.select("__id").join(known, "__id").groupBy("__y").count().collect()}
    u = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.coalesce("__t", F.lit(b"")), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("__y") == 1, F.lit(min(1.0, TRAIN_DOCS[1] / max(1, counts.get(1, 0))))).otherwise(
        F.lit(min(1.0, TRAIN_DOCS[0] / max(1, counts.get(0, 0)))))
    largest = max(min(1.0, TRAIN_DOCS[y] / max(1, counts.get(y, 0))) for y in (0, 1))
    return rows.where(u < F.lit(largest)).join(known, "__id").where(u < rate)  # few texts reach the join


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Train on a bounded sample of the labelled rows (about ``TRAIN_DOCS`` of each class at most), every word of them."""
    rows = sample(docs, labels, doc_id, label, text).select("__id", "__y", "__t")
    texts, ys = Encoded(), []
    for r in materialize(rows).orderBy(F.xxhash64("__id"), "__id", "__t").toLocalIterator():
        texts.add(words_of(bytes(r["__t"])) if r["__t"] is not None else [])
        ys.append(r["__y"])
    return train(texts, np.array(ys, int))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` plus ``__toxicity`` from 0 to 1.

    Null and wordless texts get the score of an empty bag; repeated rows get the same score; an
    empty table gives an empty result.  Without labels of both classes all scores are the rate of toxic labels.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict[bytes, float] = {}
        for b in batches:
            out = [shared.value.score(words_of(t), cache) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=[*b.schema.names[:-1], "__toxicity"])

    src = docs.select(*keep, text_bytes(text).alias("__t"))
    return map_texts(src, run, src.drop("__t").withColumn("__toxicity", F.lit(0.0)).schema)
