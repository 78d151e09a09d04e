"""Line dedup by a deletion-neighbourhood join: equal lines, and lines within one edit.

Distinct lines are found by a 128-bit hash, their earliest place is kept.  Two lines of lengths n and n or n + 1
within one edit are equal after one character of a place is deleted (of both for a substitution, of the longer
for an insertion).  All such variants are emitted as hashed keys, but only where a partner is possible:

1. a line is cut into 2 blocks; an edit falls in one of them, so partners share the hash of the rest.  Lines that share
   no such hash with another line have no partner and need no variants;
2. the same with 16 blocks for the lines that are left, now with their texts;
3. the variants that delete a character of a shared block are joined on equal keys.  Lines that share a
   substitution key are one edit apart from each other, and an insertion key links the longer lines to the shorter: stars;
4. the edit distance of every link is verified on the texts.

Classes are components of links; the earliest line of a class (document id, then line number) stays.  A document is
its id and the hash of its text: texts without an id, or different ones under one id, keep their own lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import connected_components, map_texts, materialize, text_bytes

# Shorter lines (characters) match only if equal: one edit of a few characters is another text.
MIN_CHARS = 20
COARSE, FINE = 2, 16
# Characters hashed at once, and rows of a table that may be broadcast.
PIECE_CHARS = 1 << 20
MAX_BROADCAST_ROWS = 1_000_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_U = np.uint64


def _powers(base: np.uint64, n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse modulo 2 ** 64, for k up to n."""
    if len(cache.get(base, ((),))[0]) <= n:
        inverse = _U(pow(int(base), -1, 1 << 64))
        size = 1 << (n + 1).bit_length()
        cache[base] = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))
    return cache[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hash of any range of a string of code points, from prefix sums of ``c[k] * base ** k``."""

    def __init__(self, code: np.ndarray, cache: dict, base: np.uint64 = _BASES[0]):
        power, self.inverse = _powers(base, len(code) + 2, cache)
        self.power = power
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_mix(code.astype(np.uint64) + _U(1)) * power[:len(code)], out=self.sums[1:])

    def raw(self, a, b):
        """Polynomial of [a, b), as if it began at 0."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def without(self, a, s, e, b):
        """Polynomial of [a, b) with [s, e) taken out."""
        return self.raw(a, s) + self.raw(e, b) * self.power[s - a]


def _block_keys(h: Hashes, a: np.ndarray, b: np.ndarray, blocks: int):
    """For lines [a, b): keys of shape (lines, 2 * blocks), for n = length and n = length - 1, block by block."""
    out = np.empty((len(a), 2 * blocks), np.uint64)
    for extra in (0, 1):
        n = b - a - extra
        for j in range(blocks):
            s, rest = j * n // blocks, n - (j + 1) * n // blocks
            body = h.without(a, a + s, b - rest, b)
            out[:, extra * blocks + j] = _mix(body + _mix((n * blocks + j).astype(np.uint64)))
    return out


def _lines(texts: list[bytes | None]):
    """Pieces (first text, number of lines of each text, code points, starts, ends) of joined texts."""
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k < len(texts) and (not group or size + len(texts[k] or b"") <= PIECE_CHARS):
            group.append(texts[k])
            size += len(texts[k] or b"")
            k += 1
        joined = b"\n".join(t or b"" for t in group).decode("utf-8", "replace").encode("utf-32-le")
        code = np.frombuffer(joined, np.uint32)
        ends = np.append(np.flatnonzero(code == 10), len(code))
        counts = np.array([(t or b"").count(b"\n") + 1 for t in group])
        yield k - len(group), counts, code, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends.astype(np.int64)


def _copy(text: str) -> Column:
    """128 bits of a text; with the id they name a document."""
    return F.unhex(F.md5(text_bytes(text)))


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line that is not blank: doc_id, copy (hash of the text), line (from 0), h1, h2, n (characters), keys (coarse block keys)."""
    def run(batches):
        cache: dict = {}
        for b in batches:
            ids, copies = b.column(0), b.column(1)
            for first, counts, code, start, end in _lines(b.column(2).to_pylist()):
                solid = np.concatenate([[0], np.cumsum((code > 32) & (code != 0xA0))])
                keep = np.flatnonzero(solid[end] > solid[start])
                doc = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                a, e = start[keep], end[keep]
                h, h_two = Hashes(code, cache), Hashes(code, cache, _BASES[1])
                size = (e - a).astype(np.uint64)
                near = e - a >= MIN_CHARS
                keys = np.zeros((len(a), 2 * COARSE), np.uint64)
                keys[near] = _block_keys(h, a[near], e[near], COARSE)
                used = np.where(near, 2 * COARSE, 0)
                at = pa.array(first + doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), copies.take(at), pa.array(number[keep], pa.int32()),
                     pa.array(_mix(h.raw(a, e) + _mix(size)).view(np.int64)), pa.array(_mix(h_two.raw(a, e) + _mix(size)).view(np.int64)),
                     pa.array((e - a), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]), pa.int32()), pa.array(keys[near].view(np.int64).ravel()))],
                    names=["doc_id", "copy", "line", "h1", "h2", "n", "keys"])

    src = docs.select(F.col(doc_id).alias("doc_id"), _copy(text).alias("copy"), text_bytes(text).alias("t")).where("t is not null")
    schema = src.select("doc_id", "copy", F.lit(0).alias("line"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "n")],
                        F.lit(None).cast("array<bigint>").alias("keys")).schema
    return map_texts(src, run, schema)


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most MAX_BROADCAST_ROWS narrow rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _texts_of(docs: DataFrame, places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(lid, line text) of the distinct lines at ``places`` (doc_id, copy, line, lid)."""
    per_doc = materialize(places.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("line", "lid")).alias("want")))  # at most a document's lines

    def run(batches):
        for b in batches:
            lid, out = [], []
            for data, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = data.split(b"\n")
                for w in want:
                    lid.append(w["lid"])
                    out.append(lines[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(out, pa.binary())], names=["lid", "t"])

    src = docs.select(F.col(doc_id).alias("__id"), _copy(text).alias("__copy"), text_bytes(text).alias("t")).where("t is not null")
    joined = src.join(_small(per_doc), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__copy") == F.col("copy"))).select("t", "want")
    return map_texts(joined, run, "lid long, t binary")


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def near_links(lines: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect the lines (lid, t) within one edit of each other."""
    def fine(batches):
        cache: dict = {}
        for b in batches:
            lid, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = _codes(t)
                lid.append(i)
                keys.append(_block_keys(Hashes(code, cache), np.zeros(1, np.int64), np.array([len(code)]), FINE)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["lid", "keys"])

    keyed = map_texts(lines, fine, "lid long, keys array<bigint>").select("lid", F.posexplode("keys").alias("place", "key"))
    keyed = materialize(keyed)
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    wanted = keyed.join(shared, "key", "left_semi").groupBy("lid").agg(F.collect_set("place").alias("places"))  # at most 32

    def variants(batches):
        cache: dict = {}
        for b in batches:
            lid, key, hub = [], [], []
            for i, t, places in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True):
                code = _codes(t)
                h, size = Hashes(code, cache), len(code)
                for p in places:
                    extra, j = divmod(p, FINE)
                    n = size - extra
                    s, e = j * n // FINE, size - (n - (j + 1) * n // FINE)
                    at = np.arange(s, e)
                    body = h.without(np.zeros(len(at), np.int64), at, at + 1, np.full(len(at), size))
                    if extra:  # longer line of an insertion
                        made = _mix(body + _mix(np.full(len(at), 2 * n, np.uint64)))
                        centre = np.zeros(len(at), bool)
                    else:  # substitutions share the place; the whole line is the centre of its insertions
                        made = np.append(_mix(body + _mix(_mix(at.astype(np.uint64)) + _U(2 * n + 1))),
                                         _mix(h.raw(np.zeros(1, np.int64), np.array([size])) + _mix(np.array([2 * n], np.uint64))))
                        centre = np.append(np.ones(len(at), bool), True)
                    lid += [i] * len(made)
                    key.append(made.view(np.int64))
                    hub.append(centre)
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(flat(key, np.int64)), pa.array(flat(hub, bool))], names=["lid", "key", "hub"])

    made = materialize(map_texts(lines.join(wanted, "lid").select("lid", "t", "places"), variants, "lid long, key long, hub boolean").distinct())
    centres = made.groupBy("key").agg(F.min(F.when(F.col("hub"), F.col("lid"))).alias("a"), F.count("*").alias("m")).where("m > 1 and a is not null")
    pairs = made.join(centres.select("key", "a"), "key").where("a <> lid").select("a", F.col("lid").alias("b")).distinct()
    text = lines.select("lid", F.col("t").cast("string").alias("t"))
    both = pairs.join(text.select(F.col("lid").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("lid").alias("b"), F.col("t").alias("tb")), "b")
    return both.where(F.levenshtein("ta", "tb", 1) >= 0).select("a", "b")


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``copy`` and ``lines``: the line numbers (from 0) that repeat an earlier line, for documents that have any."""
    table = materialize(line_table(docs, doc_id, text))
    lines = table.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "copy", "line")).alias("first"), F.count("*").alias("m"),
                                          F.min("n").alias("n"), F.max("keys").alias("keys"))
    lines = materialize(materialize(lines).withColumn("lid", F.monotonically_increasing_id()))
    keyed = lines.where(F.col("n") >= MIN_CHARS).select("lid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    survivors = keyed.join(shared, "key", "left_semi").select("lid").distinct()
    places = lines.join(survivors, "lid", "left_semi").select("first.doc_id", "first.copy", "first.line", "lid")
    texts = materialize(_texts_of(docs, places, doc_id, text).dropDuplicates(["lid"]))
    comp = connected_components(near_links(texts), "a", "b")
    rooted = lines.join(comp.select(F.col("node").alias("lid"), "component"), "lid", "left").select(
        "h1", "h2", "first", "m", F.coalesce("component", "lid").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("earliest"), F.sum("m").alias("total"))
    repeated = rooted.join(classes.where("total > 1"), "root").select("h1", "h2", "earliest")
    drop = table.select("doc_id", "copy", "line", "h1", "h2").join(repeated, ["h1", "h2"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("copy") == F.col("earliest.copy")) & (F.col("line") == F.col("earliest.line"))))
    return drop.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("line")).alias("lines"))  # at most a document's lines


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with repeated lines taken out of ``text``, plus ``__n_lines`` and ``__n_dropped``.

    Lines end at a newline.  Blank lines (characters up to U+0020 and U+00A0 only) are kept, as are null texts (no lines) and empty ones (one blank line).
    The order of lines is (doc_id, hash of the text, line number), a null id first; rows with the same id (or none) and
    the same text are one document and are changed alike, all others lose lines of their own.  An empty table gives an empty result.
    """
    drops = materialize(duplicate_lines(docs, doc_id, text).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), F.col("lines").alias("__lines")))
    others = [c for c in docs.columns if c != text]

    def run(batches):
        for b in batches:
            out, n, dropped = [], [], []
            for data, gone in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if data is None:
                    out.append(None)
                    n.append(0)
                    dropped.append(0)
                    continue
                lines, gone = data.split(b"\n"), set(gone or ())
                kept = [x for k, x in enumerate(lines) if k not in gone]
                out.append(b"\n".join(kept))
                n.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=[*b.schema.names[:-2], "__text", "__n_lines", "__n_dropped"])

    src = docs.join(_small(drops), F.col(doc_id).eqNullSafe(F.col("__id")) & _copy(text).eqNullSafe(F.col("__copy")), "left").select(*others, text_bytes(text).alias("__t"), "__lines")
    schema = src.select(*others, F.col("__t").alias("__text"), F.lit(0).cast("long").alias("__n_lines"), F.lit(0).cast("long").alias("__n_dropped")).schema
    out = map_texts(src, run, schema).withColumn("__text", F.col("__text").cast("string"))
    return out.select(*[F.col("__text").alias(text) if c == text else F.col(c) for c in docs.columns], "__n_lines", "__n_dropped")
