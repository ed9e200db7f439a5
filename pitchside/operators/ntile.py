"""Equal-count banding (SQL ``NTILE(n) OVER (ORDER BY ...)``) without a global window.

A window with ORDER BY and no PARTITION BY moves every row into one task. Here only the n - 1 rows
that end a tile are looked for, by exact selection. First a histogram of the leading order column
(one row per value, counted map-side) tells in which value each tile ends; then the rows of those
values alone, at most n - 1 of them, are ranked by the other order columns. Every row then gets
``1 + #{t : row > last row of tile t}``, a projection against literal tuples: rows are neither
shuffled nor written for it.

Both steps rank in range partitions: partition counts tell which one holds a wanted rank, and only
those are sorted for it. Any orderable types serve. The order columns must identify a row uniquely
(add a key as the last tie column); without it tiles of tied rows are not defined, as with
SQL NTILE. Ordering is ascending with NULLs first, the SQL default for
ascending keys in the reference's database. The input is read three times; one that may differ
from one evaluation to the next (it calls ``rand``, say) is written first, and read from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def tile_bounds(total: int, n: int) -> list[int]:
    """Last rank of tiles 1..n-1 that are followed by a non-empty tile (SQL NTILE sizing)."""
    base, rem = divmod(total, n)
    bounds = []
    for t in range(1, n):
        r = t * base + min(t, rem)
        if 0 < r < total:
            bounds.append(r)
    return bounds


def _after(col: Column, value) -> Column:
    """col > value, ascending with NULLs first; never NULL."""
    if value is None:
        return col.isNotNull()
    return F.coalesce(col > F.lit(value), F.lit(False))


def _same(col: Column, value) -> Column:
    if value is None:
        return col.isNull()
    return F.coalesce(col == F.lit(value), F.lit(False))


def tuple_after(cols: Sequence[str], values: Sequence) -> Column:
    """Lexicographic (cols) > (values) under ascending NULLS FIRST order."""
    expr = None
    for c, v in reversed(list(zip(cols, values))):
        col = F.col(c)
        step = _after(col, v) if expr is None else (_after(col, v) | (_same(col, v) & expr))
        expr = step
    return expr


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Ranked:
    """Rows ``(_group, keys..., _n)`` in order of their keys within each group, each counting ``_n`` times; ranks are looked up by partition."""

    def __init__(self, rows: DataFrame, keys: Sequence[str]):
        self.keys, self.order = list(keys), [F.col(k).asc_nulls_first() for k in keys]
        self.rows = _written(rows.repartitionByRange("_group", *self.order).withColumn("_part", F.spark_partition_id()), "ntile")
        # One row per partition and group in it.
        self.counts = self.rows.groupBy("_group", "_part").agg(F.sum("_n").alias("n")).orderBy("_group", "_part").collect()

    def total(self, group: int) -> int:
        return sum(r["n"] for r in self.counts if r["_group"] == group)

    def find(self, wanted: Sequence[tuple[int, int]]) -> list[tuple[tuple, int, bool]]:
        """For each ``(group, rank)`` the keys of the row that holds the rank, the rank among its copies, and whether that is the last of them."""
        at = []
        for group, rank in wanted:
            before = 0
            for r in (r for r in self.counts if r["_group"] == group):
                if rank <= before + r["n"]:
                    at.append((group, r["_part"], rank - before))
                    break
                before += r["n"]
        parts = sorted({p for _, p, _ in at})
        upto = F.sum("_n").over(Window.partitionBy("_part", "_group").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0))
        placed = self.rows.where(F.col("_part").isin(parts)).withColumn("_upto", upto)
        holds = F.lit(False)
        for group, part, rank in set(at):
            holds = holds | ((F.col("_group") == group) & (F.col("_part") == part) & (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank))
        rows = placed.where(holds).collect()     # one per wanted rank at most
        out = []
        for group, part, rank in at:
            r = next(r for r in rows if r["_group"] == group and r["_part"] == part and r["_upto"] - r["_n"] < rank <= r["_upto"])
            out.append((tuple(r[k] for k in self.keys), rank - (r["_upto"] - r["_n"]), rank == r["_upto"]))
        return out


def ntile_scalable(df: DataFrame, n: int, order_by: Sequence[str], out_col: str = "tile") -> DataFrame:
    """Add ``out_col`` = NTILE(n) OVER (ORDER BY order_by ASC NULLS FIRST)."""
    if not df._jdf.queryExecution().analyzed().deterministic():
        df = _written(df, "ntile-input")
    first, rest = order_by[0], list(order_by[1:])
    histogram = _Ranked(df.groupBy(F.col(first)).agg(F.count(F.lit(1)).alias("_n")).select(F.lit(0).alias("_group"), first, "_n"), [first])
    bounds = tile_bounds(histogram.total(0), n)
    found = histogram.find([(0, b) for b in bounds]) if bounds else []
    # A tile that ends with the last row of a value ends there whatever the other columns are.
    ends = [values for values, _, last in found if last or not rest]
    inside = [(values[0], rank) for values, rank, last in found if rest and not last]
    if inside:
        held = list(dict.fromkeys(v for v, _ in inside))
        group = F.lit(None).cast("int")
        for i, v in enumerate(held):
            group = F.when(_same(F.col(first), v), i).otherwise(group)
        rows = df.select(group.alias("_group"), *rest, F.lit(1).cast("long").alias("_n")).where(F.col("_group").isNotNull())
        ends += [(v, *values) for (v, _), (values, _, _) in zip(inside, _Ranked(rows, rest).find([(held.index(v), rank) for v, rank in inside]))]
    tile = F.lit(1)
    for values in ends:
        tile = tile + tuple_after(order_by[:len(values)], values).cast("int")
    return df.withColumn(out_col, tile.cast("int"))
