"""Mixing sources to target weights by systematic sampling.

DataFrame operations only. Every document of a source expects ``target / source size``
copies (3 at most). The documents of a source stand in a fixed order; the prefix sum of
expected copies, shifted by one random offset per source, crosses whole numbers, and a
document is emitted once per crossing.

The prefix sum never puts a source into one task. The order is (size level, hash cell,
size, id): a level holds sizes that agree in length and leading bits, and the number of
cells is about the square root of the number of rows. A document's place is the rows of
earlier levels + those of earlier cells + its place within its cell, so each window sees
about ``sqrt(rows)`` rows, whatever share of all rows a source, a size or a group of copies has.

Edge cases: null text has size 0; null sources form one source, ordered last; documents
of size 0 expect as many copies as the others of their source; a source of size 0 has
target 0 and no copies; equal rows are told apart by position only; input columns named
like an output are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, unit_draw

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Targets for one row per source ``(skey, size)``: shares by weight, none above ``most`` times its size.

    Sources fill up in the order of size over weight. With the first k capped, the others
    share what remains at one level per weight; the level that holds is the first that its
    own source does not exceed. One row per source is all that meets in one task.
    """
    order = Window.orderBy("skey")
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    caps = ranked.select("skey", "size", weight.alias("w"), (F.col("size") * float(most)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    every = Window.partitionBy()
    level = ((F.sum("size").over(every) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    steps = caps.withColumn("at", F.row_number().over(fill)).withColumn("level", level)
    holds = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))).over(every)
    return steps.withColumn("holds", holds).select(
        "skey", F.col("size").alias("source_size"),
        F.coalesce(F.least(F.col("cap"), F.col("holds.level") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES, seed: str = "mix",
        id_col: str = "doc_id", text_col: str | None = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """``docs`` with its columns and size, source_size, target and copies (how often the mix takes the document).

    Sizes are counted in ``text_col``, or taken from ``size_col`` when a caller has dropped the texts.
    """
    counted = F.col(size_col) if size_col else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    cells = max(1, math.isqrt(docs.count()))
    bits = F.bin("_size")
    # Keys sort as the contract asks: code point order, the null source last.
    rows = docs.select(
        *[F.col(c) for c in keep], counted.cast("long").alias("_size"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("_skey"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_hash"))
    rows = rows.withColumn("_level", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))).withColumn(
        "_cell", (F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % cells).cast("int"))

    counts = rows.groupBy("_skey", "_level", "_cell").agg(F.count("*").alias("n"), F.sum("_size").alias("size"))
    levels = counts.groupBy("_skey", "_level").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    targets = source_targets(levels.groupBy(F.col("_skey").alias("skey")).agg(F.sum("size").alias("size")), weights, most)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level_starts = levels.select("_skey", "_level", before(Window.partitionBy("_skey").orderBy("_level")).alias("_l0")).join(
        targets.withColumnRenamed("skey", "_skey"), "_skey")
    starts = counts.select(
        "_skey", "_level", "_cell", before(Window.partitionBy("_skey", "_level").orderBy("_cell")).alias("_c0")).join(
        level_starts, ["_skey", "_level"]).select(
        "_skey", "_level", "_cell", (F.col("_l0") + F.col("_c0")).alias("_start"), F.col("source_size").alias("_ssize"),
        F.col("target").alias("_target"))

    here = Window.partitionBy("_skey", "_level", "_cell").orderBy("_size", "_hash", *([id_col] if id_col in keep else []))
    placed = rows.join(starts, ["_skey", "_level", "_cell"]).withColumn("_place", F.col("_start") + F.row_number().over(here))
    ratio = F.when(F.col("_ssize") > 0, F.col("_target") / F.col("_ssize")).otherwise(F.lit(0.0))
    offset = unit_draw(F.concat(F.lit(seed), F.col("_skey")))
    copies = F.floor(ratio * F.col("_place") + offset) - F.floor(ratio * (F.col("_place") - 1) + offset)
    return placed.select(*[F.col(c) for c in keep], F.col("_size").alias("size"), F.col("_ssize").alias("source_size"),
                         F.col("_target").alias("target"), F.least(copies, F.lit(most)).alias("copies"))


def taken_documents(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words"))
    return mix(sized, size_col="words").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents),
n AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS cells FROM d),
s AS (SELECT skey, sum(size) AS size, row_number() OVER (ORDER BY skey) - 1 AS i FROM d GROUP BY skey),
w AS (SELECT skey, CAST(size AS BIGINT) AS size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][i % 3 + 1] AS w, CAST(size AS BIGINT) * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, row_number() OVER f AS pos,
         (sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW f AS (ORDER BY cap / w, skey)),
h AS (SELECT arg_min(level, pos) AS level FROM l WHERE level <= cap / w),
t AS (SELECT skey, size AS source_size, coalesce(least(cap, (SELECT level FROM h) * w), 0) AS target FROM l),
p AS (
  SELECT d.*, row_number() OVER (
           PARTITION BY skey ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 4),
           CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (SELECT cells FROM n), size, hash, doc_id) AS place,
         CAST('0x' || substr(md5('mix' || skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d),
r AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM p JOIN t USING (skey))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(least(floor(r * place + u) - floor(r * (place - 1) + u), 3) AS BIGINT) * size AS taken
FROM r
"""
