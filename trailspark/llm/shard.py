"""Sharding by sampled splitters: near-equal bytes in every shard.

1. a sample of record keys is drawn from all records, weighted by size;
2. its quantiles are the splitters of fine ranges, and records are range-partitioned by them;
3. ranges that turn out overfull are subdivided by further splitters until none is;
4. exact bytes and rows of the ranges lay them end to end, and inside a range a running sum gives
   each record its place among all bytes: shard k holds what lies from k to k + 1 shares.

The key is (hash of the text, hash of the id): equal texts are neighbours and stay together
unless a boundary runs through them.  Rows that are equal in text and id (or have no id) are numbered, and the number
goes into the key, so a group of copies of any size is divisible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import materialize

SHARDS = 8
# A range holds about so many bytes, and there are at least so many ranges.
RANGE_BYTES = 64 << 20
MIN_RANGES = 256
# Keys sampled per range; the driver sees sampled keys and range totals only.
SAMPLES_PER_RANGE = 64
OVERFULL = 1.5
ROUNDS = 6
# One task numbers at most 2 to this power rows of a group of copies.
CHUNK_BITS = 16


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Upper half: hash of the text (null like empty); lower half: hash of the id."""
    whole = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.shiftleft(F.shiftright(whole, 32), 32).bitwiseOR(F.xxhash64(F.col(doc_id).cast("string")).bitwiseAND(F.lit(0xFFFFFFFF)))


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """``__uid``, ``__number`` of the rows that share key and tie with others: 0, 1, ... in each group.

    A group is numbered in chunks of bounded size (``CHUNK_BITS``), each from the sum of the chunks before it, so no task
    holds a group whole.
    """
    group = ["__key", "__tie"]
    chunks = rows.groupBy(*group, F.shiftright("__uid", CHUNK_BITS).alias("__chunk")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = materialize(chunks.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0)))
                         .withColumn("__all", F.sum("n").over(Window.partitionBy(*group))).where("__all > 1").drop("n", "__all"))
    inside = Window.partitionBy(*group, "__chunk").orderBy("__uid")
    return (rows.withColumn("__chunk", F.shiftright("__uid", CHUNK_BITS)).join(chunks, [*group, "__chunk"])
            .select("__uid", (F.col("__first") + F.row_number().over(inside) - 1).alias("__number")))


class _Ranges:
    """Splitters with the bytes and rows that lie before each range."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts

    def number(self) -> Column:
        cuts = self.cuts

        @F.pandas_udf("int")
        def number(key: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

        return number("__key")

    def fill(self, narrow: DataFrame) -> None:
        self.bytes, self.rows = (np.zeros(len(self.cuts) + 1, np.int64) for _ in range(2))
        for r in narrow.groupBy(self.number().alias("r")).agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect():
            self.bytes[r["r"]], self.rows[r["r"]] = r["b"], r["n"]

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds ``__at`` (bytes before the record) and ``__row`` (records before it)."""
        cuts, b, n = self.cuts, np.cumsum(self.bytes) - self.bytes, np.cumsum(self.rows) - self.rows

        @F.pandas_udf("r int, b long, n long")
        def place(key: pd.Series) -> pd.DataFrame:
            r = np.searchsorted(cuts, key.to_numpy(), side="right")
            return pd.DataFrame({"r": r.astype(np.int32), "b": b[r], "n": n[r]})

        w = Window.partitionBy("__p.r").orderBy("__key", "__tie", "__size")
        return (df.withColumn("__p", place("__key"))
                .withColumn("__n", F.row_number().over(w))
                .withColumn("__sum", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("__at", F.col("__p.b") + F.col("__sum") - F.col("__size"))
                .withColumn("__row", F.col("__p.n") + F.col("__n") - 1).drop("__p", "__n", "__sum"))


def _split(narrow: DataFrame, ranges: int, total: int) -> _Ranges:
    """Splitters from a size-weighted sample, subdivided until no divisible range is overfull."""
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    u = F.pmod(F.xxhash64("__key", "__tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))  # the same in a rerun task
    rows = narrow.where(u < F.col("__size") * F.lit(rate)).select(
        "__key", F.greatest(F.lit(1.0), F.col("__size") * F.lit(rate)).alias("w")).toPandas().sort_values("__key")
    keys, mass = rows["__key"].to_numpy(np.int64), rows["w"].to_numpy().cumsum()
    cuts = np.zeros(0, np.int64)
    if len(keys):
        cuts = np.unique(keys[np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges)])
    out = _Ranges(cuts)
    out.fill(narrow)
    for _ in range(ROUNDS):
        target = OVERFULL * total / ranges
        lo = np.concatenate([[np.iinfo(np.int64).min], out.cuts])
        hi = np.concatenate([out.cuts, [np.iinfo(np.int64).max]])
        more = []
        for r in np.flatnonzero(out.bytes > target):
            inside = keys[(keys > lo[r]) & (keys < hi[r])]
            k = int(np.ceil(out.bytes[r] / target))
            if len(inside) >= k:
                more += [inside[len(inside) * j // k] for j in range(1, k)]
            elif hi[r] - 1 > lo[r]:  # no sampled key: halve the interval
                more.append(int(lo[r]) + (int(hi[r]) - int(lo[r])) // 2)
        cuts = np.unique(np.concatenate([out.cuts, np.array(more, np.int64)]))
        if len(cuts) == len(out.cuts):
            break
        out = _Ranges(cuts)
        out.fill(narrow)
    return out


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", size: str = "__size", key: str = "__key", shards: int = SHARDS,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with ``__shard`` (0 to shards - 1) and ``__slot`` (gapless from 0 in each shard).

    ``docs`` carries ``__size`` (:func:`text_size`) and ``__key`` (:func:`record_key`).  Bytes of
    shards differ by no more than about two of the largest records.  Null texts have size 1; null ids and
    repeated rows are placed like others, each row in a slot of its own; an empty
    table gives an empty result; other columns are kept as they are.
    """
    df = docs.withColumn("__tie", F.xxhash64(F.col(doc_id).cast("string"), F.lit(1)))
    narrow = materialize(df.select(F.col(key).alias("__key"), F.col(size).alias("__size"), "__tie"))
    if not narrow.groupBy("__key", "__tie").count().where("count > 1").isEmpty():
        # numbers of rows hold only in a written table, so rows are written once with theirs
        df = materialize(df.withColumn("__uid", F.monotonically_increasing_id()))
        numbers = materialize(_copy_numbers(df.select(F.col(key).alias("__key"), "__tie", "__uid")))
        low = F.xxhash64("__tie", "__number").bitwiseAND(F.lit(0xFFFFFFFF))
        numbered = F.shiftleft(F.shiftright(key, 32), 32).bitwiseOR(low)
        df = (df.join(numbers, "__uid", "left").withColumn(key, F.when(F.col("__number") > 0, numbered).otherwise(F.col(key)))
              .withColumn("__tie", F.xxhash64("__tie", F.coalesce("__number", F.lit(0)))).drop("__uid", "__number"))
        narrow = materialize(df.select(F.col(key).alias("__key"), F.col(size).alias("__size"), "__tie"))
    total = narrow.agg(F.sum("__size")).first()[0] or 0
    ranges = _split(narrow, max(MIN_RANGES, -(-total // range_bytes)), total)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("__at") + F.col("__size") / 2) * F.lit(shards / max(total, 1)))).cast("int")
    first = {r[0]: r[1] for r in ranges.placed(narrow).groupBy(shard.alias("s")).agg(F.min("__row")).collect()}
    start = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return (ranges.placed(df).withColumn("__shard", shard)
            .withColumn("__slot", F.col("__row") - F.element_at(start, F.col("__shard") + 1)).drop("__at", "__row", "__tie"))
