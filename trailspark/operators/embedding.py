"""Dense document vectors (T7): randomised truncated SVD of the TF-IDF matrix.

The matrix (documents x hashed terms, TF-IDF, rows of length one) is never held: the terms of every document are written
once as hash numbers, and each pass multiplies the rows of a task's batches with a thin matrix.

* range finder: B = A' (A Q) for a random thin Q, orthonormalised, repeated; tasks send one sum per hashed term;
* Gramian: of Q' A' A Q, thin x thin, whose leading eigenvectors turn Q into the right singular vectors V;
* the vector of a document is its row times V, scaled to length one.

What the driver holds is terms x thin numbers, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import word_terms
from trailspark.session import materialize

FEATURES = 4096
DIMS = 48
OVERSAMPLE = 8
POWER_ROUNDS = 2
# Documents per core below which the table is dealt out anew.
SMALL_ROWS = 50_000


def term_hashes(text: str, features: int = FEATURES) -> Column:
    """Hash number of every term of a text, repeats included; a null text has none."""
    return F.coalesce(F.transform(word_terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int")), F.array().cast("array<int>"))


# Rows of a block, and terms a row from which a block is held as a matrix: its product is then faster than sorting and gathering the terms.
BLOCK_ROWS = 256
DENSE_TERMS = 100


class _Dense:
    """The TF-IDF rows of a block as a matrix: terms are counted in place, without a sort."""

    def __init__(self, hashes: pa.Array, idf: np.ndarray):
        length = hashes.value_lengths().to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(length)) * len(idf), length) + hashes.flatten().to_numpy(zero_copy_only=False)
        self.a = np.bincount(key, minlength=len(length) * len(idf)).reshape(len(length), len(idf)) * idf
        self.a /= np.maximum(np.sqrt(np.einsum("ij,ij->i", self.a, self.a)), 1e-300)[:, None]

    def times(self, m: np.ndarray) -> np.ndarray:
        return self.a @ m

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        out += self.a.T @ y


def _rows(hashes: pa.Array, idf: np.ndarray) -> _Dense | _Rows:
    many = 0 < len(hashes) <= BLOCK_ROWS and len(hashes.flatten()) >= DENSE_TERMS * len(hashes)
    return (_Dense if many else _Rows)(hashes, idf)


class _Rows:
    """The TF-IDF rows of an Arrow batch as sorted (row, term, weight) triples."""

    def __init__(self, hashes: pa.Array, idf: np.ndarray):
        length = hashes.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(length)), length)
        key, count = np.unique(row * len(idf) + hashes.flatten().to_numpy(zero_copy_only=False), return_counts=True)
        self.row, self.term = np.divmod(key, len(idf))
        w = count * idf[self.term]
        self.n = len(length)
        norm = np.sqrt(np.bincount(self.row, w * w, self.n))
        self.weight = w / np.maximum(norm, 1e-300)[self.row]

    def times(self, m: np.ndarray) -> np.ndarray:
        """Rows times a thin matrix."""
        out = np.zeros((self.n, m.shape[1]))
        if len(self.row):
            first = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[first]] = np.add.reduceat(self.weight[:, None] * m[self.term], first, axis=0)
        return out

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds the transposed rows times ``y`` (one line per row) to ``out``."""
        if len(self.row):
            by = np.argsort(self.term, kind="stable")
            term = self.term[by]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            out[term[first]] += np.add.reduceat(self.weight[by, None] * y[self.row[by]], first, axis=0)


def _cut(batch: pa.RecordBatch, terms: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many terms: one document at least."""
    size = batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // terms
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(size) else []
    for a, b in zip(first, [*first[1:], len(size)], strict=True):
        yield batch.slice(a, b - a)


def _gram_times(hashed: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A' A Q: every task adds up its rows, the sums are added by term."""
    def add(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            for part in _cut(batch):
                rows = _rows(part.column(part.num_columns - 1), idf)
                rows.add_transposed(rows.times(q), total)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), **{f"x{k}": total[some, k] for k in range(q.shape[1])}})

    names = [f"x{k}" for k in range(q.shape[1])]
    sums = hashed.select("_hashes").mapInArrow(add, "term int, " + ", ".join(f"{n} double" for n in names))
    found = sums.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most one row per hashed term
    out = np.zeros(q.shape)
    out[found["term"].to_numpy(np.int64)] = found[names].to_numpy()
    return out


def fit_svd(hashed: DataFrame, dims: int = DIMS, features: int = FEATURES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(idf, V): inverse document frequencies and the ``dims`` leading right singular vectors of the TF-IDF rows of ``hashed`` (column ``_hashes``)."""
    n = hashed.count()
    seen = hashed.select(F.explode(F.array_distinct("_hashes")).alias("_h")).groupBy("_h").count().collect()  # one row per hashed term
    df = np.zeros(features)
    df[[r["_h"] for r in seen]] = [r["count"] for r in seen]
    idf = np.log((n + 1) / (df + 1))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, min(features, dims + OVERSAMPLE))))[0]
    for _ in range(POWER_ROUNDS):
        q = np.linalg.qr(_gram_times(hashed, idf, q))[0]
    b = _gram_times(hashed, idf, q)
    values, turn = np.linalg.eigh((q.T @ b + b.T @ q) / 2)
    v = q @ turn[:, np.argsort(-values)[:dims]]
    return idf, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def embed(df: DataFrame, text: str = "journal_story", dims: int = DIMS, features: int = FEATURES, seed: int = 42, out: str = "vector") -> DataFrame:
    """``df`` without ``text`` and with ``out``, an ``array<double>`` of length one (zeros for a text without terms).

    The texts are read once; all passes read the written hash numbers.  The result is written, so later steps read it as it is.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    hashed = materialize(df.select(*keep, term_hashes(text, features).alias("_hashes")))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if hashed.count() < SMALL_ROWS * cores:  # a small table of few files: deal it to all cores once, for all passes
        hashed = materialize(hashed.repartition(cores))
    idf, v = fit_svd(hashed, dims, features, seed)

    def project(batches):
        for batch in batches:
            for part in _cut(batch):
                y = _Rows(part.column(part.num_columns - 1), idf).times(v)  # row by row, so that equal texts have equal vectors
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                vectors = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32), y.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors], [*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields[:-1])
    return materialize(hashed.mapInArrow(project, f"{schema}, `{out}` array<double>"))
