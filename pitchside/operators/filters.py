"""Coverage and sample-size filters, period-over-period change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_coverage(df: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, periods) = number of distinct periods each entity appears in.

    Two hash aggregations instead of a distinct aggregate: (entity, period)
    pairs first (partial aggregation map-side), then a count per entity.
    """
    pairs = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("_rows"))
    return pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("periods"))


def with_full_coverage(df: DataFrame, entity: str, period: str, n: int | Column) -> DataFrame:
    """Keep entities present in exactly ``n`` periods (returns (entity, periods))."""
    return period_coverage(df, entity, period).where(F.col("periods") == n)


def min_sample(df: DataFrame, count_col: str, n: int) -> DataFrame:
    """Post-aggregate filter on a group size column (SQL HAVING COUNT(*) >= n)."""
    return df.where(F.col(count_col) >= n)


def period_delta(df: DataFrame, order_col: str, cols: Mapping[str, str], scale: int = 2) -> DataFrame:
    """Value minus the previous period's (already rounded) value, rounded again.

    ``df`` must hold one row per period (an aggregate), so the un-partitioned
    window is bounded by the number of periods, not by the fact.
    """
    w = Window.orderBy(order_col)
    for out, src in cols.items():
        df = df.withColumn(out, F.round(F.col(src) - F.lag(src).over(w), scale))
    return df
