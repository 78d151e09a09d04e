"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of distinct character n-grams (1 to ``ORDER`` characters,
letters lower-cased, other characters one space) present in both, divided by the geometric
mean of their own numbers.  Landmark texts give Nystroem features ``K(x, L) K(L, L)^-1/2``, on
which one ridge regression per language is solved in closed form.  Scoring folds landmarks,
Nystroem map and weights into one matrix over n-grams, so a batch of whole texts is one
product of its presence matrix with that matrix.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import doc_fold, map_texts

ORDER = 3
# n-grams are numbered by a hash of this many bits.
HASH_BITS = 18
# Bounds of what the fit reads: labelled texts and landmarks of each language.
TRAIN_PER_LANG = 400
LANDMARKS_PER_LANG = 40
RIDGE = 1e-2
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Texts longer than this are read in overlapping pieces, whose n-grams are united.
PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the distinct n-grams of the whole text; empty without a letter.

    ``seen`` is a scratch table of 2 ** HASH_BITS false values, handed back clean.
    """
    any_letter = False
    for k in range(0, len(text), PIECE):
        part = np.frombuffer(text[max(0, k - ORDER):k + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[part]
        if not letter.any():
            continue
        any_letter = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each run of letters
        code = np.where(letter, part, 32)[keep].astype(np.uint64)
        code = np.concatenate([np.array([32], np.uint64), code])
        gram = code
        for n in range(1, ORDER + 1):
            if n > 1:
                if len(code) < n:
                    break
                gram = gram[:-1] * np.uint64(1 << 21) + code[n - 1:]
            seen[((gram + np.uint64(n << 60)) * _MULTIPLIER) >> np.uint64(64 - HASH_BITS)] = True
    if not any_letter:
        return np.zeros(0, np.int32)
    out = np.flatnonzero(seen).astype(np.int32)
    seen[out] = False
    return out


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray  # n-gram number -> row of weights, -1 if in no landmark
    weights: np.ndarray  # rows of n-grams, one column per language
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values of a batch of n-gram sets: presence matrix times weights."""
        present = np.zeros((len(sets), len(self.weights)), np.float32)
        size = np.ones(len(sets))
        for r, s in enumerate(sets):
            cols = self.column[s]
            present[r, cols[cols >= 0]] = 1
            size[r] = max(1, len(s))
        return (present @ self.weights) / np.sqrt(size)[:, None] + self.bias


def training_rows(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """A sample of about ``per_lang`` rows of each language, by a hash of the id, so a rerun draws the same."""
    counts = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    if not counts:
        return docs
    rate = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))]), F.col(lang))
    return docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = TRAIN_PER_LANG,
        landmarks: int = LANDMARKS_PER_LANG) -> Model:
    """Kernel ridge regression on a bounded sample of labelled rows (null languages and letterless texts teach nothing)."""
    def run(batches):
        seen = np.zeros(1 << HASH_BITS, bool)
        for b in batches:
            sets = [ngrams(t or "", seen).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["lang", "o", "grams"])

    rows = training_rows(labelled.where(F.col(lang).isNotNull()), lang, doc_id, per_lang)
    src = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("o"), F.col(text).cast("string").alias("t"))
    got = [r for r in map_texts(src, run, "lang string, o long, grams binary").collect() if r["grams"]]  # a few hundred a language
    got.sort(key=lambda r: (r["lang"], r["o"], bytes(r["grams"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], np.full(1 << HASH_BITS, -1, np.int32), np.zeros((0, 0), np.float32), np.zeros(0))
    sets = [np.frombuffer(bytes(r["grams"]), np.int32) for r in got]
    taken: dict[str, int] = {}
    land = []
    for i, r in enumerate(got):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= landmarks:
            land.append(i)
    column = np.full(1 << HASH_BITS, -1, np.int32)
    used = np.unique(np.concatenate([sets[i] for i in land]))
    column[used] = np.arange(len(used))
    base = np.zeros((len(land), len(used)), np.float32)
    for r, i in enumerate(land):
        base[r, column[sets[i]]] = 1 / np.sqrt(len(sets[i]))
    kernel = np.zeros((len(sets), len(land)))
    for k in range(0, len(sets), 64):  # batched products of presence matrices
        present = np.zeros((len(sets[k:k + 64]), len(used)), np.float32)
        for r, s in enumerate(sets[k:k + 64]):
            cols = column[s]
            present[r, cols[cols >= 0]] = 1 / np.sqrt(len(s))
        kernel[k:k + 64] = present @ base.T
    value, vector = np.linalg.eigh(kernel[land])
    keep = value > 1e-6 * value.max()
    nystroem = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([kernel @ nystroem, np.ones((len(sets), 1))])
    y = np.where(np.array([r["lang"] for r in got])[:, None] == np.array(langs), 1.0, -1.0)
    ridge = RIDGE * np.eye(z.shape[1]) * len(sets) / z.shape[1]
    ridge[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    return Model(langs, column, (base.T @ (nystroem @ w[:-1])).astype(np.float32), w[-1])


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` plus ``__lang_pred`` and ``__lang_score``.

    Null texts and texts without a letter are ``und`` with score 0, as is all text if nothing
    was learned.  The score is the winning regression value moved from [-1, 1] to [0, 1]; ties go
    to the first language.  Repeated rows get the same answer; an empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        seen = np.zeros(1 << HASH_BITS, bool)
        for b in batches:
            sets = [ngrams(t or "", seen) for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score = [UNKNOWN] * len(sets), np.zeros(len(sets))
            rows = [i for i, s in enumerate(sets) if len(s) and m.langs]
            for k in range(0, len(rows), 64):
                f = m.scores([sets[i] for i in rows[k:k + 64]])
                best = f.argmax(1)
                for i, j, x in zip(rows[k:k + 64], best, f.max(1), strict=True):
                    pred[i], score[i] = m.langs[j], min(1.0, max(0.0, (1 + x) / 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred), pa.array(score)],
                                             names=[*b.schema.names[:-1], "__lang_pred", "__lang_score"])

    src = docs.select(*keep, F.col(text).cast("string").alias("__t"))
    return map_texts(src, run, src.drop("__t").withColumns({"__lang_pred": F.lit(""), "__lang_score": F.lit(0.0)}).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return doc_fold(doc_id, 3) == 1
