"""Mixing sources to target weights by iterative proportional fitting.

Token counts of all documents are summed per cell (one value of each margin: source, language,
topic).  Raking scales the cells to each margin's target shares in turn until all hold within ``TOLERANCE``, or
for ``ROUNDS`` rounds if they contradict each other; :func:`margin_errors` tells what is left.  A document's
calibrated weight is its cell's fitted share over the cell's share of tokens.  Documents are sampled with
probabilities proportional to it, at the rate that keeps the wanted share of all tokens in
expectation; cells whose probability would exceed 1 are kept whole and the rate makes up for them.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import materialize

ROUNDS = 40
# Raking ends when, in a whole round, no margin's share was further than this from its target.
TOLERANCE = 1e-14
# Expected share of all tokens that the sample keeps.
KEEP = 0.5
# Target share of a category is its token share to this power, unless targets are given.
TEMPER = 0.7
# Cells (not documents) up to this number are raked in numpy and broadcast; beyond it by aggregations and joins.
MAX_LOCAL_CELLS = 200_000
# Seeds whose occurrences make a document's topic; the most frequent wins, ties go to the first.
TOPIC_SEEDS = {"a": ["on"], "b": ["th"], "c": ["ch", "en"], "d": ["ou", "eu"], "e": ["ci", "os"]}
NO_TOPIC = "none"


def token_count(text: str = "text") -> Column:
    """Words (runs of anything but space and \\t\\n\\v\\f\\r); a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str = "text", seeds: Mapping[str, list[str]] = TOPIC_SEEDS) -> Column:
    """Topic with the most occurrences of its seeds; none without any."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = {k: sum(((F.length(whole) - F.length(F.replace(whole, F.lit(s), F.lit("")))) / F.lit(len(s)) for s in words), F.lit(0.0))
              for k, words in seeds.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    out = F.when(best <= 0, F.lit(NO_TOPIC))
    for k, c in counts.items():
        out = out.when(c == best, F.lit(k))
    return out


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """Target shares of a margin: token shares to a power, normalised."""
    per = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    raised = per.select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("t"))
    total = raised.agg(F.sum("t").alias("s"))
    return raised.join(F.broadcast(total)).select(margin, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, max_local: int = MAX_LOCAL_CELLS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margin columns, ``tokens``) with ``fit``, the raked share of each cell.

    ``targets`` has for each margin a table (margin, ``target``).  A category without a target has share 0;
    a target without tokens can't be met, and the others share what remains.
    """
    cells = cells.where("tokens > 0")
    for m, t in targets.items():
        cells = cells.join(t.select(m, F.col("target").alias(f"__t_{m}")), m, "left").fillna(0.0, [f"__t_{m}"])
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = materialize(cells.withColumn("fit", F.col("tokens") / F.lit(float(whole))))
    names = [c for c in cells.columns if not c.startswith("__t_")]
    if cells.limit(max_local + 1).count() <= max_local:
        pdf = cells.toPandas().sort_values(list(targets)).reset_index(drop=True)
        w = pdf["fit"].to_numpy(float).copy()
        margins = [(pd.factorize(pdf[m])[0], pdf[f"__t_{m}"].to_numpy(float)) for m in targets]
        for _ in range(rounds):
            error = 0.0
            for group, goal in margins:
                total = np.bincount(group, weights=w, minlength=group.max(initial=0) + 1)[group]
                error = max(error, np.abs(total - goal).max(initial=0.0))
                w = np.where(total > 0, w * goal / np.where(total > 0, total, 1), 0.0)
            if error <= tolerance:
                break
        pdf["fit"] = w / w.sum() if w.sum() > 0 else w
        return cells.sparkSession.createDataFrame(pdf[names], cells.select(names).schema)
    for _ in range(rounds):
        cells = cells.withColumn("__error", F.lit(0.0))
        for m in targets:
            total = cells.groupBy(m).agg(F.sum("fit").alias("__s"))
            goal = F.col(f"__t_{m}")
            cells = (cells.join(total, m).withColumn("__error", F.greatest("__error", F.abs(F.col("__s") - goal)))
                     .withColumn("fit", F.when(F.col("__s") > 0, F.col("fit") * goal / F.col("__s")).otherwise(0.0)).drop("__s"))
        cells = materialize(cells)
        if (cells.agg(F.max("__error")).first()[0] or 0.0) <= tolerance:
            break
    total = cells.agg(F.sum("fit")).first()[0] or 1.0
    return cells.withColumn("fit", F.col("fit") / F.lit(total)).select(names)


def margin_errors(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``margin``, ``error``: the largest distance of a fitted share from its target, for every margin of :func:`rake`."""
    out = None
    for m, t in targets.items():
        got = fitted.groupBy(m).agg(F.sum("fit").alias("got")).join(t, m, "full")
        off = F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))
        one = got.agg(F.lit(m).alias("margin"), F.coalesce(F.max(off), F.lit(0.0)).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


def sampling_rate(fitted: DataFrame, keep: float = KEEP) -> float:
    """The rate s with ``sum(tokens * min(1, s * weight)) = keep * sum(tokens)`` over the cells.

    Each step takes the cells that the rate so far keeps whole and makes the rate of the others fit; it grows
    until no further cell is kept whole, after a few steps over the table of cells.  If cells with a weight hold fewer
    tokens than wanted, all of them are kept.
    """
    cells = fitted.select("tokens", "weight").where("weight > 0")
    goal = keep * (fitted.agg(F.sum("tokens")).first()[0] or 0)
    rate, kept = 0.0, -1
    while True:
        whole = F.col("weight") * F.lit(rate) >= 1
        r = cells.agg(F.count(F.when(whole, 1)).alias("n"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("tokens"),
                      F.sum(F.when(~whole, F.col("tokens") * F.col("weight"))).alias("rest"), F.min("weight").alias("least")).first()
        if r.least is None:
            return 0.0
        if r.rest is None:
            return 1 / r.least
        if r.n == kept:
            return rate
        rate, kept = (goal - r.tokens) / r.rest, r.n


def unit_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number in [0, 1) made from the id and the text (nulls like empty texts): different texts without an id, or under
    one id, are drawn for themselves."""
    whole = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), whole).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def features(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, Column]:
    """Margins, tokens and draw of a document; null categories are empty texts."""
    return {"__source": F.coalesce(F.col(source).cast("string"), F.lit("")), "__lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
            "__topic": topic_of(text), "__tokens": token_count(text), "__draw": unit_hash(doc_id, text)}


def mix(docs: DataFrame, power: float = TEMPER, keep: float = KEEP,
        targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` (with the columns of :func:`features`) plus ``__weight``, ``__probability`` and ``__sampled``.

    Rows are sampled, not ids: null and repeated ids change nothing but that rows equal in id and text share one draw.
    Documents of cells without tokens have weight and probability 0.  An empty table
    gives an empty result; other columns are kept as they are.
    """
    margins = ["__source", "__lang", "__topic"]
    cells = materialize(docs.groupBy(*margins).agg(F.sum("__tokens").alias("tokens")))
    fitted = rake(cells, targets or {m: tempered(cells, m, power) for m in margins})
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = fitted.withColumn("weight", F.col("fit") / (F.col("tokens") / F.lit(total)))
    rate = sampling_rate(fitted, keep)
    fitted = fitted.select(*margins, F.col("weight").alias("__weight"))
    if fitted.limit(MAX_LOCAL_CELLS + 1).count() <= MAX_LOCAL_CELLS:
        fitted = F.broadcast(fitted)
    probability = F.least(F.lit(1.0), F.col("__weight") * F.lit(rate))
    return (docs.join(fitted, margins, "left").fillna(0.0, ["__weight"]).withColumn("__probability", probability)
            .withColumn("__sampled", F.col("__draw") < F.col("__probability")))
