"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is the bitwise majority over XXH64 values of word shingles.
Distinct fingerprints are linked at ``max_bits`` or fewer differing bits:

1. bits that are correlated over all fingerprints are grouped into partitions;
2. if two fingerprints differ in at most ``tau`` bits, then for thresholds with
   ``sum(t_i) = tau - m + 1`` some partition ``i`` differs in at most ``t_i`` bits
   (-1: the partition is not probed).  A dynamic programme allocates the
   thresholds, and picks the number of partitions, by estimated candidate counts;
3. each partition is an index; fingerprints probe it with all values within ``t_i`` bits;
4. candidates are verified on the whole fingerprint.

Buckets beyond ``bucket_limit`` fingerprints are searched by an exact linear way instead:
all 65 values within one bit of each fingerprint are emitted; two fingerprints
within two bits share such a value, and all that share one are within two bits of
each other, so a star to the smallest links them (at most 65 fingerprints share a value).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import bound_batches, connected_components, map_texts, materialize, text_bytes

BITS = 64
# [A-Z] lower-cased; words are runs of anything but space and \t\n\v\f\r.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in LOWER)
BUCKET_LIMIT = 512
# Cost of writing one probe key, in pairs compared.
KEY_COST = 8.0


def _words(data: bytes) -> list[bytes]:
    return [w for w in data.translate(SPACES).split(b" ") if w]


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text; no words give zero."""
    import xxhash

    words = _words(data) if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([hash64(joined, 42)], np.uint64)
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        h = np.fromiter((hash64(joined[i:j - 1], 42) for i, j in zip(starts, ends[shingle - 1:], strict=False)),
                        np.uint64, len(words) - shingle + 1)
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    out = np.packbits(2 * count > len(h)).tobytes()
    return int.from_bytes(out, "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "__fp", shingle: int = 3) -> DataFrame:
    """``docs`` without ``text``, plus the fingerprint column ``out``."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(x, shingle) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], out])

    keep = [c for c in docs.columns if c != text]
    src = docs.select(*keep, text_bytes(text).alias("__text"))
    return map_texts(src, run, src.drop("__text").withColumn(out, F.lit(0).cast("long")).schema)


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of jointly set bits, over all of them."""
    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.unpackbits(v.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel(), float(n)], pa.float64())], names=["k", "c"])

    bound_batches(fps.sparkSession)
    rows = fps.mapInArrow(run, "k int, c double").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["k"]] = r["c"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _group_bits(joint: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Greedy partitions of equal width; each takes the free bit most correlated with its own."""
    p = np.diag(joint) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        idx = sorted(free)
        part = [idx[int(corr[np.ix_(idx, idx)].sum(1).argmax())]]
        free.discard(part[0])
        while len(part) < width:
            idx = sorted(free)
            part.append(idx[int(corr[np.ix_(idx, part)].sum(1).argmax())])
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least cost; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t1, x in enumerate(row):
                key = s + t1 - 1
                if key not in nxt or c + x < nxt[key][0]:
                    nxt[key] = (c + x, [*ts, t1 - 1])
        best = nxt
    return best.get(total, (math.inf, []))


def plan_partitions(fps: DataFrame, max_bits: int, fp: str = "fp") -> list[tuple[list[int], int]]:
    """Partitions and thresholds with the least estimated cost, from statistics of all fingerprints."""
    n, joint = _bit_statistics(fps.select(fp))
    if n < 2:
        return [(list(range(BITS)), max_bits)]
    p = np.diag(joint) / n
    agree = p * p + (1 - p) * (1 - p)
    flip = (1 - agree) / np.maximum(agree, 1e-9)
    options = {m: _group_bits(joint, n, m) for m in range(1, max_bits + 3)}
    probes = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts) if len(part) < BITS]
    keys = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(fp).bitwiseAND(F.lit(_mask(part)).cast("long")).alias("v"))
        for k, (_, _, part) in enumerate(probes)])).alias("x")).select("x.k", "x.v")
    pairs = {r["k"]: r["s"] for r in keys.groupBy("k", "v").agg(F.count("*").cast("double").alias("c"))
             .groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s")).collect()}
    same = {(m, i): pairs.get(k, 0.0) for k, (m, i, _) in enumerate(probes)}
    best = (math.inf, [], [])
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            r = flip[part]
            e1, e2 = r.sum(), (r.sum() ** 2 - (r * r).sum()) / 2
            base = max(same.get((m, i), 0.0), n * (n - 1) / 2 * float(np.prod(agree[part])))
            row, found, keys_made = [0.0], 0.0, 0
            for t in range(max_bits + 1):
                found += base * (1.0, e1, e2, e2 * e1 / 3)[min(t, 3)]
                keys_made += math.comb(len(part), t)
                row.append(found + KEY_COST * n * (keys_made + (t > 0)))
            costs.append(row)
        cost, ts = _allocate(costs, max_bits - m + 1)
        if cost < best[0]:
            best = (cost, parts, ts)
    return [(part, t) for part, t in zip(best[1], best[2], strict=True) if t >= 0]


def _variants(fp: Column, bits: list[int], t: int) -> Column:
    """All values of the partition within ``t`` bits of the fingerprint's."""
    masked = fp.bitwiseAND(F.lit(_mask(bits)).cast("long"))
    flips = [_mask(list(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: masked.bitwiseXOR(f))


def link_fingerprints(fps: DataFrame, max_bits: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints ``fp`` that connect exactly those
    within ``max_bits`` bits, directly or through others within ``max_bits`` bits."""
    if max_bits > 2:
        raise ValueError("the exact way for large buckets covers at most two bits")
    parts = plan_partitions(fps, max_bits)

    def keyed(threshold):
        rows = [fps.select("fp", F.lit(i).alias("part"), F.explode(_variants(F.col("fp"), bits, threshold(t))).alias("value"))
                for i, (bits, t) in enumerate(parts)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    index, probe = keyed(lambda t: 0), keyed(lambda t: t)
    large = materialize(index.groupBy("part", "value").count().where(F.col("count") > bucket_limit).select("part", "value"))
    plain = large.isEmpty()
    if not plain:
        hot = probe.join(large, ["part", "value"], "left_semi").select("fp").distinct()
        index = index.join(large, ["part", "value"], "left_anti")
        probe = probe.join(large, ["part", "value"], "left_anti")
    x, y = index.select("part", "value", F.col("fp").alias("a")), probe.select("part", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    edges = (x.alias("x").join(y.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value"))
                               & (F.col("a") < F.col("b")) & near).select("a", "b"))
    if plain:
        return edges
    reach = 1 if max_bits == 2 else 0
    wide = hot.select("fp", F.explode(_variants(F.col("fp"), list(range(BITS)), reach)).alias("value"))
    if max_bits == 1:  # the pair shares the value with the differing bit cleared, and the bit's place
        masks = F.array(*[F.lit(_mask([k])).cast("long") for k in range(BITS)])
        wide = hot.select("fp", F.posexplode(masks).alias("place", "m")).select(
            "fp", F.struct("place", F.col("fp").bitwiseAND(F.bitwise_not("m")).alias("v")).alias("value"))
    stars = (wide.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("bs"))
             .where(F.size("bs") > 1).select("a", F.explode("bs").alias("b")).where("a <> b"))
    return edges.unionByName(stars)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2,
               bucket_limit: int = BUCKET_LIMIT, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`near_duplicates` with the columns ``keep`` and ``root``, a fingerprint that names the component also without ids."""
    fp = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep), out="fp", shingle=shingle))
    groups = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(link_fingerprints(groups.select("fp"), max_bits, bucket_limit), "a", "b")
    rooted = groups.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return fp.join(labelled, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed 64 bits), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of ``max_bits`` or fewer
    differing bits, the document itself included.  Null and wordless texts have fingerprint
    zero and are linked like any other; texts shorter than a shingle hash their whole word
    sequence; repeated rows are returned as often as given; an empty table gives an empty result.
    A null ``doc_id`` is never the smallest (null only if no member has an id).
    """
    return components(docs, doc_id, text, shingle, max_bits, bucket_limit).select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
