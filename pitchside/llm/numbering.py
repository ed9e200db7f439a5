"""Positions of rows, in a total order or in any, without a window over them.

A row knows its place in its partition. One row per partition (and group in it) says how many rows
stand before. For an order, rows are range-partitioned by it and sorted within their partitions, so
a hot group spreads over as many partitions as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: monotonically_increasing_id: the partition stands above this bit, the row's place below it.
_PLACE_BITS = 33


def _counted(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``place`` of each row; a group's rows stand together in every partition."""
    held = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _PLACE_BITS)
    # One row per partition and group in it: as many as partitions and groups together at most.
    runs = held.groupBy(part.alias("_part"), *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(runs.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                                 (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-starts")
    alike = part == F.col("_of")
    for i, c in enumerate(by):
        alike = alike & held[c].eqNullSafe(starts[f"_by{i}"])
    return held.join(starts, alike).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``place``: the position (from 0) of a row among those alike in ``by``, ascending by ``order``, nulls first.

    Rows alike in ``by`` and ``order`` get different places in no fixed order. Null groups are groups.
    The sorted rows are written to the shared folder, so places stay as they are.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    return _counted(df.repartitionByRange(*keys).sortWithinPartitions(*keys), by, name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``place``: the rows numbered from 0 without gaps, in no particular order. Nothing is shuffled but a row per partition."""
    return _counted(df, [], name)
