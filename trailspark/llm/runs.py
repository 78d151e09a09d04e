"""Periodic runs of words by internal pattern matching.

A run of period q has at least ``max(min_words, 4 q)`` words, so for the power of two B with q < B <= 2 q it holds a whole
dyadic block of B words (one that starts at a multiple of B), and q words before or after that block, inside the run, lies
its nearest other occurrence: a nearer one would shift the run's primitive period onto itself.  So:

1. a suffix array of all words of a batch of documents, by doubling; after each doubling the suffixes that share their
   first B words are an interval of the array.  Words are numbered per document, so no occurrence leaves its document;
2. for every dyadic block that occurs again, a wavelet tree over the suffix array gives the range successor and
   predecessor of the block's place in its interval: its occurrences in the neighbouring windows;
3. an occurrence at distance B / 2 <= d < B starts a progression of difference d, a candidate period; the ranks of
   the doublings give how far the words keep that period to both sides, and what is long enough is a run.

All steps are numpy expressions over the whole batch; a batch is an Arrow batch of documents or one long document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.llm.common import map_texts, text_bytes

MIN_WORDS = 6
MIN_EXPONENT = 4
# Words of the documents that are handled at once; a longer document is a batch of its own.
BATCH_WORDS = 1 << 18


class _Suffixes:
    """Suffix array of ``key`` (symbols, equal only inside a document) and the ranks of all doublings.

    ``rank[k][i]`` is the first place in the array of the suffixes that share the first 2^k symbols with suffix i;
    the last level is the one at which every suffix is alone.
    """

    def __init__(self, key: np.ndarray):
        n = len(key)
        order = np.argsort(key, kind="stable").astype(np.int32)
        rank, size = self._ranks(key[order], order)
        self.rank, self.blocks = [rank], []
        active = np.flatnonzero(size > 1)  # suffixes that share their first symbols with others
        length = 1
        while len(active):
            after = np.full(len(active), -1, np.int64)
            inside = active + length < n
            after[inside] = rank[active[inside] + length]
            pair = rank[active] * np.int64(n + 1) + after + 1
            by = np.argsort(pair, kind="stable")
            suffix, pair = active[by], pair[by]
            new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            count = np.diff(np.r_[new, len(pair)])
            old = rank[suffix]
            group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])  # places of a group start at its old rank
            place = old + np.arange(len(old)) - np.repeat(group, np.diff(np.r_[group, len(old)]))
            order[place] = suffix
            rank = rank.copy()
            rank[suffix] = np.repeat(place[new], count)
            length *= 2
            self.rank.append(rank)
            many = np.repeat(count, count) > 1
            active = suffix[many]
            whole = active % length == 0  # the dyadic blocks among them
            self.blocks.append((length, active[whole], rank[active[whole]], np.repeat(count, count)[many][whole]))
        self.order = order

    @staticmethod
    def _ranks(ordered: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[new, len(ordered)])
        rank, size = np.empty(len(ordered), np.int32), np.empty(len(ordered), np.int32)
        rank[order], size[order] = np.repeat(new, count), np.repeat(count, count)
        return rank, size

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols from a and from b on that are equal, for places a < b."""
        n, at = len(self.order), b.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            rank, step = self.rank[k], 1 << k
            inside = at + step <= n
            x, y = np.where(inside, a + (at - b), 0), np.where(inside, at, 0)
            at += step * (inside & (rank[x] == rank[y]))
        return at - b

    def reach_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols before a and before b that are equal, for places a < b."""
        at = a.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            rank, step = self.rank[k], 1 << k
            inside = at >= step
            x = np.where(inside, at - step, 0)
            at -= step * (inside & (rank[x] == rank[x + (b - a)]))
        return a - at


class _Wavelet:
    """Wavelet tree (as a matrix: one bit vector a level, zeros first) over the numbers 0 to n - 1 in some order."""

    def __init__(self, numbers: np.ndarray):
        self.levels, x = [], numbers
        for shift in range(max(1, (len(numbers) - 1).bit_length()) - 1, -1, -1):
            one = (x >> shift & 1).astype(bool)
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((shift, ones, len(x) - int(ones[-1])))
            x = np.concatenate([x[~one], x[one]])

    def smaller(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of each interval [left, right) are below ``bound``."""
        count = np.zeros(len(left), np.int32)
        for shift, ones, zeros in self.levels:
            l1, r1 = ones[left], ones[right]
            up = (bound >> shift & 1).astype(bool)
            count += np.where(up, (right - left) - (r1 - l1), 0).astype(np.int32)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return count

    def ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of each interval that has ``place`` smaller ones in it."""
        out = np.zeros(len(left), np.int64)
        for shift, ones, zeros in self.levels:
            l1, r1 = ones[left], ones[right]
            low = (right - left) - (r1 - l1)
            up = place >= low
            out |= up.astype(np.int64) << shift
            place = np.where(up, place - low, place)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return out


def find_runs(words: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period; places are those of ``words``.

    ``words`` are numbers, ``doc`` the ascending document number of each.  ``min_exponent`` is 4 at least and ``min_words`` 3 at
    least: shorter runs need not hold a whole dyadic block.
    """
    if min_exponent < 4 or min_words < 3:
        raise ValueError("runs need an exponent of 4 and a length of 3 at least")
    if len(words) < min_words:
        return np.zeros((0, 3), np.int64)
    sa = _Suffixes(doc.astype(np.int64) * (int(words.max()) + 1) + words)
    blocks = [b for b in sa.blocks if len(b[1])]
    if not blocks:
        return np.zeros((0, 3), np.int64)
    size = np.concatenate([np.full(len(s), length, np.int64) for length, s, _, _ in blocks])
    start, left, count = (np.concatenate([b[k] for b in blocks]).astype(np.int64) for k in (1, 2, 3))
    right, tree = left + count, _Wavelet(sa.order)
    own = tree.smaller(left, right, start)
    candidates = []
    for place, exists in ((own + 1, own + 1 < count), (own - 1, own > 0)):
        other = tree.ranked(left[exists], right[exists], place[exists])
        s, b = start[exists], size[exists]
        d = np.abs(other - s)
        near = (2 * d >= b) & (d < b)
        candidates.append((np.minimum(s, other)[near], d[near]))
    at, d = (np.concatenate(x) for x in zip(*candidates, strict=True))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    begin = at - sa.reach_back(at, at + d)
    length = at + d + sa.reach(at, at + d) - begin
    long = length >= np.maximum(min_words, min_exponent * d)
    return np.unique(np.stack([begin[long], length[long], d[long]], axis=1), axis=0)[:, :3] if long.any() else np.zeros((0, 3), np.int64)


def _sorted(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word):
        k = self[word] = len(self)
        return k


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> Iterator[np.ndarray]:
    """The runs of each list of words, places counted inside it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    number = _Numbers()
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    runs = _sorted(find_runs(words, doc, min_words, min_exponent))
    cuts = np.searchsorted(runs[:, 0], np.r_[first, lengths.sum()])
    for k in range(len(texts)):
        own = runs[cuts[k]:cuts[k + 1]]
        yield own - np.array([first[k], 0, 0])


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q or n * best[2] == best[1] * q and (s, q) < (best[0], best[2]):
            best = (s, n, q)
    return best


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _batches(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    some, n = [], 0
    for t in texts:
        words = (t or b"").split()
        if some and n + len(words) > BATCH_WORDS:
            yield some
            some, n = [], 0
        some.append(words)
        n += len(words)
    if some:
        yield some


def detect_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT,
                digest: bool = False) -> DataFrame:
    """``docs`` with ``__runs`` (start, length, period of every run, by start and period) and ``__collapsed``, the text without
    the words that a run repeats, joined by one space.

    Words are what ASCII white space separates, case-sensitive.  A null or empty text has no run and an empty collapsed text;
    repeated rows and null ids are handled row by row; an empty table gives an empty result; other columns are kept,
    but columns of the two names are replaced.  With ``digest`` the texts are hashed in the task and not sent back: instead of the two
    columns come ``__n_runs``, ``__best`` (the run of greatest length / period), ``__runs_sha256`` (lines
    ``start,length,period``) and ``__collapsed_sha256``, and ``text`` is left out.  A document is handled in one task with some 300
    bytes a word.
    """
    names = ("__n_runs", "__best", "__runs_sha256", "__collapsed_sha256") if digest else ("__runs", "__collapsed")
    df = docs.drop(*names).withColumn("__bytes", text_bytes(text))
    keep = df.drop("__bytes", *([text] if digest else []))
    item = "struct<start:bigint,length:bigint,period:bigint>"
    kinds = ("bigint", item, "string", "string") if digest else (f"array<{item}>", "binary")
    df = df.select(*keep.columns, "__bytes")
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True)))
    schema = T.StructType([*keep.schema.fields, *added.fields])

    def row(words: list[bytes], runs: np.ndarray) -> tuple:
        kept = b" ".join(collapse(words, runs))
        items = runs.tolist()
        as_dict = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        if not digest:
            return [as_dict(r) for r in items], kept
        best = best_run(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in items)
        return len(items), best and as_dict(best), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        arrow = (pa.int64(), run_kind, pa.string(), pa.string()) if digest else (pa.list_(run_kind), pa.binary())
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(batch.num_columns - 1).to_pylist()):
                rows = [row(w, r) for w, r in zip(texts, runs_of(texts, min_words, min_exponent), strict=True)]
                part = batch.slice(at, len(rows))
                at += len(rows)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *names])

    out = map_texts(df, run, schema)
    return out if digest else out.withColumn("__collapsed", F.col("__collapsed").cast("string"))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, where crc32 of the id (unsigned) is a multiple of ten with its words from a on replaced by repeats of p of them.

    With n words, g = floor(crc32 / 10): a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); such a text comes back with single spaces.
    A row without an id keeps its text.
    """
    return F.expr(f"""
      if(crc32(cast(cast({doc_id} as string) as binary)) % 10 = 0,
        array_join(transform(array(struct(array_remove(split({text}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), '') as w,
                                          crc32(cast(cast({doc_id} as string) as binary)) div 10 as g)),
          x -> if(size(x.w) = 0, '', array_join(transform(x.w, (y, i) -> x.w[int(
            if(i < x.g % size(x.w), i,
               x.g % size(x.w) + (i - x.g % size(x.w)) % (1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8))))]), ' '))), ''),
        {text})""")
