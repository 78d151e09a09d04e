"""Data-quality reports that replace the reference's printed warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """one row per column with the number of null values and rows
    (one pass, partial aggregation)."""
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols]))
    return agg.select("rows", stacked.alias("s")).select("s.column", F.coalesce("s.nulls", F.lit(0)).alias("nulls"),
                                                         "rows")
