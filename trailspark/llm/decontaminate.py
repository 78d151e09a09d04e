"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every window of ``window`` consecutive item words (a shorter item is one window) is a
record of word shingles that a document must hold completely and in place:

1. shingles are ordered by rarity, their number of occurrences in all documents;
2. containment of the whole window makes one prefix token necessary: its rarest shingle.
   Document positions join on these prefix tokens alone;
3. length and positional bounds place the window inside the document;
4. the window's words are compared one by one.

Documents are never shuffled.  The benchmark is read in blocks of at most ``block_words`` words
(long items are cut into overlapping pieces, so no window is lost); a block's index is
what the tasks receive, so its size is bounded whatever the benchmark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import map_texts, materialize, text_bytes

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 400_000
PIECE_WORDS = 10_000
# Candidate (window, position) pairs that a task verifies at once.
CANDIDATES = 1 << 16
# Words are runs of anything but \x00-\x2F \x3A-\x60 \x7B-\x7F, after A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(TABLE).split() if data else []


class Index:
    """Windows of one benchmark block as word numbers; 0 is a word of no window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in pieces:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1):
                owners.setdefault(tuple(ids[s:s + size]), set()).add(item)
        self.base = len(self.vocab) + 1
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        # shingles by size: a window shorter than the shingle is one shingle itself
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})
        self.of_window = [[(min(shingle, len(w)), self._code(w[o:o + shingle])) for o in range(max(1, len(w) - shingle + 1))]
                          for w in self.windows]
        self.tokens = {k: np.array(sorted({c for row in self.of_window for kk, c in row if kk == k}), np.int64) for k in self.sizes}

    def _code(self, ids) -> int:
        code = 0
        for i in ids:
            code = code * self.base + i
        return code

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray, size: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle is among the sorted tokens, and the token numbers."""
        n = len(ids) - size + 1
        if n <= 0 or not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids[:n] > 0
        for j in range(1, size):
            known &= ids[j:n + j] > 0
        at = np.flatnonzero(known)
        code = ids[at]
        for j in range(1, size):
            code = code * self.base + ids[at + j]
        k = np.minimum(np.searchsorted(tokens, code), len(tokens) - 1)
        ok = tokens[k] == code
        return at[ok], k[ok]

    def order_by_rarity(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle (ties: the first) as its prefix token."""
        posting: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for w, row in enumerate(self.of_window):
            best = min(range(len(row)), key=lambda o: (counts[row[o][0]][np.searchsorted(self.tokens[row[o][0]], row[o][1])], o))
            posting.setdefault(row[best], []).append((w, best))
        self.prefix, self.lists = {}, {}
        for k in self.sizes:
            codes = sorted(c for kk, c in posting if kk == k)
            rows = [posting[k, c] for c in codes]
            self.prefix[k] = np.array(codes, np.int64)
            first = np.cumsum([0, *map(len, rows)])
            self.lists[k] = (first, np.array([x for r in rows for x in r], np.int64).reshape(-1, 2))
        width = max(map(len, self.windows), default=1)
        self.lens = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.array([w + (0,) * (width - len(w)) for w in self.windows], np.int64).reshape(-1, width)
        del self.of_window, self.tokens

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Verified (window, start) pairs of one document."""
        ids = self.numbers(words)
        found_w, found_s = [], []
        for k in self.sizes:
            at, tok = self.found(ids, k, self.prefix[k])
            if not len(at):
                continue
            first, rows = self.lists[k]
            postings = first[tok + 1] - first[tok]
            cols = np.arange(self.matrix.shape[1])
            done = np.cumsum(postings)
            cuts = [0, *np.flatnonzero(np.diff(done // CANDIDATES)) + 1, len(at)]
            for i, j in zip(cuts, cuts[1:], strict=False):  # about CANDIDATES at once
                n = postings[i:j]
                row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[tok[i:j]], n)
                w, s = rows[row, 0], np.repeat(at[i:j], n) - rows[row, 1]
                fits = (s >= 0) & (s + self.lens[w] <= len(ids))
                w, s = w[fits], s[fits]
                inside = cols < self.lens[w][:, None]
                same = np.where(inside, ids[np.minimum(s[:, None] + cols, len(ids) - 1)] == self.matrix[w], True).all(1)
                found_w.append(w[same])
                found_s.append(s[same])
        if not found_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_w), np.concatenate(found_s)


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Rows (item, words joined by a space, n) of items cut into overlapping pieces."""
    def run(batches):
        for b in batches:
            items, joined, n = [], [], []
            for item, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(data)
                for s in range(0, len(words), PIECE_WORDS):
                    if s and len(words) - s < window:
                        break  # covered by the piece before
                    part = words[s:s + PIECE_WORDS + window - 1]
                    items.append(item)
                    joined.append(b" ".join(part))
                    n.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(joined, pa.binary()), pa.array(n, pa.int64())],
                                             names=["item", "words", "n"])

    src = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("t"))
    return map_texts(src, run, "item string, words binary, n long")


def _rarity(docs: DataFrame, index) -> dict[int, np.ndarray]:
    """Occurrences of the block's shingles in all documents."""
    def run(batches):
        ix = index.value
        total = {k: np.zeros(len(ix.tokens[k]), np.int64) for k in ix.sizes}
        for b in batches:
            for data in b.column(0).to_pylist():
                ids = ix.numbers(words_of(data))
                for k in ix.sizes:
                    total[k] += np.bincount(ix.found(ids, k, ix.tokens[k])[1], minlength=len(total[k]))
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())],
                                             names=["k", "token", "n"])

    counts = {k: np.zeros(len(index.value.tokens[k]), np.int64) for k in index.value.sizes}
    for r in (map_texts(docs.select(text_bytes("text")), run, "k int, token long, n long")
              .groupBy("k", "token").agg(F.sum("n").alias("n")).collect()):  # at most the block's shingles
        counts[r["k"]][r["token"]] = r["n"]
    return counts


def find_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` plus ``__n_words``, ``__n_hit``, ``__spans`` and ``__items``, one row per row of ``docs``.

    ``__spans`` are the merged word ranges [start, end) inside occurrences of a window, ``__n_hit`` is
    their length, ``__items`` the sorted ids (as text) of items with an occurring window.  A null or
    wordless text has no words; a null or wordless item has no window; a null item id is written
    as an empty text; repeated rows are judged each; empty tables give no hits.
    """
    pieces = materialize(_pieces(benchmark, item_id, item_text, window).distinct())  # rows repeated in the benchmark count once
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text).alias("text"))

    def searched(src: DataFrame, index) -> DataFrame:
        def run(batches):
            ix = index.value
            for b in batches:
                n_words, n_hit, spans, items = [], [], [], []
                for data in b.column(b.num_columns - 1).to_pylist():
                    words = words_of(data)
                    w, s = ix.hits(words) if words else (np.zeros(0, np.int64),) * 2
                    runs = merge(sorted(zip(s.tolist(), (s + ix.lens[w]).tolist(), strict=True))) if len(w) else []
                    n_words.append(len(words))
                    n_hit.append(sum(e - a for a, e in runs))
                    spans.append([{"start": a, "end": e} for a, e in runs])
                    items.append(sorted({x for i in set(w.tolist()) for x in ix.owners[i]}))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                    names=[*b.schema.names[:-1], "__n_words", "__n_hit", "__spans", "__items"])

        schema = src.select(*src.columns, F.lit(0).cast("long").alias("__n_words"), F.lit(0).cast("long").alias("__n_hit"),
                            F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("__spans"),
                            F.lit(None).cast("array<string>").alias("__items")).schema
        return map_texts(src.select(*src.columns, text_bytes(text).alias("__t")), run, schema)

    def block_index(k: int):
        rows = pieces.where(F.col("block") == k).collect()  # about block_words words
        ix = Index([(r["item"], bytes(r["words"]).split(b" ")) for r in rows], window, shingle)
        seen = sc.broadcast(ix)
        counts = _rarity(texts, seen)
        ix.order_by_rarity(counts)
        return sc.broadcast(ix)

    if blocks == 1:
        return searched(docs, block_index(0))
    key = [F.col(doc_id).alias("__id"), F.sha2(F.coalesce(text_bytes(text), F.lit(b"")), 256).alias("__sha")]
    found = None
    for k in range(blocks):
        hit = searched(docs.select(*key, F.col(text)), block_index(k)).where("__n_hit > 0").select("__id", "__sha", "__n_words", "__spans", "__items")
        hit = materialize(hit.dropDuplicates(["__id", "__sha"]))
        found = hit if found is None else found.unionByName(hit)
    merged = found.groupBy("__id", "__sha").agg(
        F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__spans"),  # at most one row per block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))

    def joined(batches):
        for b in batches:
            spans = [merge([(x["start"], x["end"]) for x in r or []]) for r in b.column("__spans").to_pylist()]
            i = b.schema.get_field_index("__spans")
            at = b.num_columns - 1
            arrays = list(b.columns)
            arrays[i] = pa.array([[{"start": a, "end": e} for a, e in r] for r in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            arrays[b.schema.get_field_index("__n_hit")] = pa.array([sum(e - a for a, e in r) for r in spans], pa.int64())
            arrays[at] = pa.array([len(words_of(t)) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "__n_words"])

    out = docs.select(*docs.columns, *key).alias("d").join(
        merged.alias("m"), F.col("d.__id").eqNullSafe(F.col("m.__id")) & (F.col("d.__sha") == F.col("m.__sha")), "left").select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("__n_hit"), F.col("m.__spans"),
        F.coalesce("m.__items", F.array().cast("array<string>")).alias("__items"), text_bytes(f"d.`{text}`").alias("__t"))
    schema = out.drop("__t").withColumn("__n_words", F.lit(0).cast("long")).schema
    return map_texts(out, joined, schema)


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted half-open ranges."""
    out: list[list[int]] = []
    for a, e in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]
