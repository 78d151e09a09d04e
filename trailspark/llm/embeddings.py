"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

A unit vector ``x`` is stored as int8 codes ``q`` with a scale, ``x = s q + e``, and the norms of ``s q`` and
``e``.  For two vectors ``|x.y - s s' q.q'| <= |e||s'q'| + |sq||e'| + |e||e'|``, so an integer product
of two tiles of codes decides most pairs: below the threshold by more than the bound, no link; above it by
more than the bound, a link.  Only the pairs between are recomputed in double precision.

Equal vectors of a label are one representative with a count.  Representatives of a label are
dealt to tiles of about ``TILE`` rows, and each pair of tiles is one group of bounded size, which
gives counts of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import bound_batches, connected_components, materialize

THRESHOLD = 0.98
TILE = 1024
# Float rounding of unit vectors, products and bounds, far above double precision's.
SLACK = 1e-9
BLOCK = 256
# Numbers of tiles are broadcast up to so many (label, length) groups, and joined beyond.
MAX_BROADCAST_GROUPS = 20_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the decoded vectors and norms of the errors, per row."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float):
    """Yields (rows of a, rows of b) of all pairs with cosine >= threshold, block by block of ``a``."""
    qb, sb, nb, eb = quantise(b)
    qb = qb.astype(np.float32)  # integer products stay exact below 2**24 in float32
    exact_in_float = a.shape[1] * 127 * 127 < 1 << 24
    for k in range(0, len(a), BLOCK):
        qa, sa, na, ea = quantise(a[k:k + BLOCK])
        product = qa.astype(np.float32) @ qb.T if exact_in_float else (qa.astype(np.float64) @ qb.T.astype(np.float64))
        near = product * sa[:, None] * sb
        bound = ea[:, None] * nb + na[:, None] * eb + ea[:, None] * eb + SLACK
        sure = near - bound >= threshold
        i, j = np.nonzero(~sure & (near + bound >= threshold))
        for cut in range(0, len(i), 1 << 15):
            x, y = i[cut:cut + (1 << 15)], j[cut:cut + (1 << 15)]
            sure[x, y] = np.einsum("ij,ij->i", a[k + x], b[y]) >= threshold
        i, j = np.nonzero(sure)
        yield i + k, j


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row reachable from each of ``n`` rows, by hooking and pointer jumping."""
    root = np.arange(n)
    while pairs:
        low = [np.minimum(root[i], root[j]) for i, j in pairs]
        for (i, j), m in zip(pairs, low, strict=True):
            np.minimum.at(root, root[i], m)
            np.minimum.at(root, root[j], m)
        while (root[root] != root).any():
            root = root[root]
        if all((root[i] == root[j]).all() for i, j in pairs):
            break
    return root


def _unit(embedding: str) -> F.Column:
    """Unit vector in double precision; scaled by the largest component first, so that no square over- or underflows."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    top = F.array_max(F.transform(x, F.abs))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad & (F.size(x) > 0) & (top > 0), F.transform(x, lambda v: v / top))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows with a null label or a vector that is null, empty, zero or holds null or non-finite
    components link with nothing and are their own component, as are vectors of unlike lengths to each
    other.  Equal vectors of a label link with each other.  A repeated id counts as another vector; a null id
    is never the smallest.  An empty table gives an empty result.
    """
    bound_batches(vectors.sparkSession)
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), _unit(embedding).alias("y"))
    norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v))
    rows = materialize(src.withColumn("norm", norm).select(
        "vec_id", "label", F.when(F.col("label").isNotNull(), F.transform("y", lambda v: v / F.col("norm"))).alias("u")))
    alone = rows.where(F.col("u").isNull())
    good = rows.where(F.col("u").isNotNull())
    reps = materialize(good.groupBy("label", "u").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()).withColumn("d", F.size("u")))
    tiles = reps.groupBy("label", "d").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    if tiles.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        tiles = F.broadcast(tiles)
    dealt = (reps.select("rep", "label", "d", "n", "u").join(tiles, ["label", "d"])
             .withColumn("i", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("label", "d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "n", "u"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        pdf = pdf.sort_values("i", kind="stable")
        rep, n, x = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), np.stack(pdf["u"].to_numpy())
        cut = len(pdf) if lo == hi else int((pdf["i"] == lo).sum())
        shift = 0 if lo == hi else cut
        links, pairs = np.zeros(len(pdf), np.int64), []
        for i, j in linked(x[:cut], x[shift:], threshold):
            j = j + shift
            if lo == hi:  # each pair once
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, weights=n[j], minlength=len(links)).astype(np.int64)
            links += np.bincount(j, weights=n[i], minlength=len(links)).astype(np.int64)
            if len(i):
                pairs.append((i, j))
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[_forest(len(pdf), pairs)][some]})

    found = materialize(dealt.groupBy("label", "d", "lo", "hi").applyInPandas(compare, "rep long, links long, root long"))
    comp = connected_components(found.select("rep", "root"), "rep", "root").select(F.col("node").alias("rep"), "component")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = reps.join(comp, "rep", "left").join(links, "rep", "left").select(
        "label", "u", "n", "first_id", F.coalesce("component", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(smallest, "root").select("label", "u", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = good.join(known, ["label", "u"]).select("vec_id", "n_links", "component_id").unionByName(
        alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
