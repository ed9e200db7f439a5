"""Whitening of embeddings with distributed block matrices.

Vectors become whole numbers, ``floor(scale * entry)``. The fit list holds each distinct one once,
with its sums per dimension, exact. Its centred rows are indexed and dealt into blocks; the
transposed matrix times the matrix is the scatter, one small matrix of dimension x dimension that
alone comes to the driver; its eigenvectors over the roots of their eigenvalues are the whitening
matrix, and the blocks times that matrix are the whitened rows. A product of two tall matrices has
one block, which a plain multiplication would make in one task; the inner dimension is therefore
split, so each task multiplies a bounded number of blocks and only their small products meet.

Edge cases: vectors that are null, empty or hold a null or non-finite entry are left out; vectors
of different lengths are whitened apart from each other; entries beyond the range of a 64-bit
integer stand at its end. A component without variance (all of them, if there is only one distinct
vector) has no whitened value (null), counts as explaining 0 and is not part of ``identity_error``;
``identity_error`` is 0 where no component has variance. ``deviation`` is exact; beyond 64 bits it is null and only ``deviation_decimal`` has it, up to
38 digits, beyond them it is null as well. Equal vectors, null and repeated ids keep their rows;
an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .numbering import numbered

#: Rows and columns of a block, and blocks that a task multiplies in one step.
BLOCK_ROWS, BLOCK_COLUMNS, BLOCKS = 2048, 512, 8
COMPONENTS = 4
SCALE = 256.0


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left * right`` with the inner dimension dealt to ``splits`` tasks per block of the result (which Python's ``multiply`` has no argument for)."""
    of = lambda m: m._java_matrix_wrapper._java_model
    return BlockMatrix(of(left).multiply(of(right), splits), left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    splits = -(-matrix.numRows() // (BLOCK_ROWS * BLOCKS))
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """A block matrix of rows ``(place, c)``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("place", array_to_vector("c").alias("c")), "c")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, min(width, BLOCK_COLUMNS))


def _small(spark: SparkSession, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A matrix of one embedding's size, as blocks."""
    height, width = matrix.shape
    parts = [((i, 0), DenseMatrix(len(part), width, part.ravel(order="F")))
             for i, part in enumerate(matrix[k:k + rows_per_block] for k in range(0, height, rows_per_block))]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), rows_per_block, width, height, width)


def _deviation(x: Column, n: int, sums: list) -> Column:
    """The exact sum of ``(n * x - sum) ** 2`` over the dimensions, null beyond 38 digits."""
    whole = "decimal(38,0)"
    shifted = F.zip_with(x, F.array(*[F.lit(int(s)).cast(whole) for s in sums]), lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast(whole), a.cast(whole)).cast(whole), s).cast(whole))
    return F.aggregate(shifted, F.lit(0).cast(whole), lambda done, d: F.try_add(done, F.try_multiply(d, d).cast(whole)).cast(whole))


def _whitened(distinct: DataFrame, width: int, components: int) -> DataFrame:
    """``(key, n, deviation, component, whitened, explained, identity_error)`` for distinct vectors ``(key, x)`` of one length."""
    spark = distinct.sparkSession
    rows = written(numbered(distinct, "whitening-numbered"), "whitening-rows")
    n = rows.count()
    # One row per dimension.
    sums = [r["s"] for r in rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]
    means = F.array(*[F.lit(float(s) / n) for s in sums])
    centred = rows.select("place", F.zip_with("x", means, lambda a, m: a.cast("double") - m).alias("c"))
    matrix = _blocks(centred, n, width)
    covariance = _scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(components, width)
    varies = values[:k] > max(float(values[0]), 1e-300) * width * 1e-14
    trace = float(np.trace(covariance))
    explained = [float(v) / trace if there else 0.0 for v, there in zip(values[:k], varies, strict=True)]
    named = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(explained[i]).alias("explained")) for i in range(k)])
    facts = rows.select("place", "key", F.lit(n).cast("long").alias("n"), _deviation(F.col("x"), n, sums).alias("deviation"), named.alias("named"))
    used = int(varies.sum())  # they fall, so those with variance come first
    if not used:
        return facts.select("key", "n", "deviation", F.inline("named")).select("*", F.lit(None).cast("double").alias("whitened"), F.lit(0.0).alias("identity_error"))
    projected = _product(matrix, _small(spark, vectors[:, :used] / np.sqrt(values[:used]), min(width, BLOCK_COLUMNS)))
    error = float(np.abs(_scatter(projected) / n - np.eye(used)).max())
    indexed = projected.toIndexedRowMatrix()  # held by a name: Python gives a matrix up to the JVM as soon as nothing refers to it
    back = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    white = written(back.select(F.col("index").alias("place"), vector_to_array("vector").alias("white")), "whitening-white")
    each = facts.join(white, "place").select("key", "n", "deviation", "white", F.inline("named"))
    return each.select("key", "n", "deviation", "component", "explained", F.get("white", F.col("component") - 1).alias("whitened"), F.lit(error).alias("identity_error"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error, deviation_decimal."""
    v = F.col("v")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(v) > 0)
    given = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fit)
    whole = given.select("id", F.transform("v", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))
    # Two hashes of the vector: 128 bits that stand for it.
    rows = written(whole.select("id", "x", F.size("x").alias("width"), F.concat(F.hex(F.xxhash64("x")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "x"))).alias("key")), "whitening-given")
    widths = [r[0] for r in rows.select("width").distinct().orderBy("width").collect()]  # lengths of vectors: one, as a rule
    found = [_whitened(rows.where(F.col("width") == w).groupBy("key").agg(F.first("x").alias("x")), w, components) for w in widths]
    if not found:
        return rows.select("id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
                           F.lit(0).cast("decimal(38,0)").alias("deviation_decimal")).withColumnRenamed("id", id_col)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = written(every, "whitening-found")
    return rows.select("id", "key").join(every, "key").select(
        F.col("id").alias(id_col), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_decimal"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
