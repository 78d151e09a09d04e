"""Small DataFrame building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` with pandas semantics: null rows are kept."""
    return ~col(c).eqNullSafe(F.lit(value))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` drops rows with a null key; Spark keeps them."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """Dense 1..k position inside each group by a total order; keep ``<= n``.

    ``row_number`` filtered by a constant becomes ``WindowGroupLimit``: a
    partial top-n runs before the shuffle, so a hot group ships only ``n``
    rows per input partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= n) if n is not None else out


def ordered_list(order, value) -> Column:
    """Array of ``value`` ordered by ``order`` (for groups of bounded size)."""
    s = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(value).alias("v"))))
    return F.transform(s, lambda x: x["v"])


def ordered_join(order, value, sep: str) -> Column:
    """String aggregation of ``value`` ordered by ``order`` (bounded groups)."""
    return F.array_join(ordered_list(order, value), sep)


def wide(arr: Column, n: int, name: str) -> list[Column]:
    """List -> numbered columns ``name_1..name_n`` padded with null."""
    return [F.get(arr, i).alias(f"{name}_{i + 1}") for i in range(n)]
