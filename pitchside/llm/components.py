"""Connected components by alternating large-star and small-star steps, in DataFrame operations only.

Every step is a grouped minimum (combined map-side) and an equi-join on the node
whose two sides are plain shuffles, so a hub's rows can be split by adaptive
skew handling. Edges and minima are written to the shared folder after each
step: lineage stays short, and a lost executor costs one step at most. The
driver sees only two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-min")
    return both.join(lows, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lows = written(down.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
    moved = down.join(lows, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(lows.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (its first two columns, any one orderable type).

    ``component`` is the smallest node reachable. Self-loops, repeated and null-ended
    edges are allowed: a self-loop gives its node a component of its own, edges with a
    null end are ignored, an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given = written(given.distinct(), "cc-edges")
    loops = given.where("a = b").select("a", "b")
    now = given.where("a <> b")
    mark = _mark(now)
    while mark[0]:
        now = written(_large_star(now).where("a <> b").distinct(), "cc-edges")
        now = written(_small_star(now).where("a <> b").distinct(), "cc-edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
