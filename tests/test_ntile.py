"""The scalable NTILE equals SQL NTILE, including NULL keys, a hot key and tiny inputs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchside.operators.ntile import ntile_scalable, tile_bounds


def builtin(df, n, cols):
    w = Window.orderBy(*[F.col(c).asc_nulls_first() for c in cols])
    return df.withColumn("expected", F.ntile(n).over(w))


def check(df, n, cols):
    got = ntile_scalable(df, n, cols, out_col="tile")
    joined = builtin(got, n, cols)
    bad = joined.where(F.col("tile") != F.col("expected")).count()
    assert bad == 0
    return got


@pytest.mark.parametrize("total,n", [(10, 3), (3, 5), (1, 3), (7, 7), (100, 1), (0, 3)])
def test_tile_bounds_sizes(total, n):
    bounds = tile_bounds(total, n)
    assert all(0 < b < total for b in bounds)
    assert bounds == sorted(set(bounds))


def test_hot_key_and_nulls(spark):
    # A third of the rows share one key, some keys are NULL; ties broken by id.
    df = spark.range(0, 3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7))
         .when(F.col("id") % 97 == 0, F.lit(None))
         .otherwise(F.col("id") % 50).cast("int").alias("k"))
    check(df, 3, ["k", "id"])
    check(df, 7, ["k", "id"])


def test_double_key_and_string_tie(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 17 / F.lit(3.0)).alias("x"),
        F.col("id"),
        F.when(F.col("id") % 2 == 0, "H").otherwise("A").alias("side"))
    check(df, 4, ["x", "id", "side"])


def test_fewer_rows_than_tiles(spark):
    df = spark.range(0, 2).select(F.col("id"), F.col("id").alias("k"))
    got = check(df, 5, ["k", "id"])
    assert sorted(r["tile"] for r in got.collect()) == [1, 2]


def test_empty_input(spark):
    df = spark.range(0, 0).select(F.col("id"), F.col("id").alias("k"))
    assert ntile_scalable(df, 3, ["k", "id"]).count() == 0


def test_no_single_partition_window_over_rows(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 10).alias("k"))
    plan = ntile_scalable(df, 3, ["k", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "SinglePartition" not in plan


def test_boundaries_sharing_one_hot_value(spark):
    # 80% of the rows share one key, so several tile boundaries fall inside the same value
    df = spark.range(0, 2000).select(
        F.col("id"), F.when(F.col("id") % 5 != 0, F.lit(3)).otherwise(F.col("id") % 7).cast("int").alias("k"))
    check(df, 5, ["k", "id"])


def test_full_range_64_bit_tie_key(spark):
    # hashed ids span the whole long range
    df = spark.range(0, 3000).select(F.xxhash64("id").alias("h"), (F.col("id") % 3).cast("int").alias("k"))
    check(df, 4, ["k", "h"])
    check(df, 3, ["h"])


def test_text_and_timestamp_keys_of_many_values(spark):
    df = spark.range(0, 20_000).select(
        F.md5(F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.xxhash64("id") % 10**9)).alias("at"), "id")
    check(df, 5, ["name", "id"])
    check(df, 3, ["at", "name"])


def test_input_that_differs_per_evaluation(spark):
    df = spark.range(0, 2000).select("id", F.rand().alias("x"))
    got = ntile_scalable(df, 4, ["x", "id"])
    assert [r["n"] for r in got.groupBy("tile").agg(F.count("*").alias("n")).orderBy("tile").collect()] == [500] * 4


def test_tuple_after_nulls_first(spark):
    from pitchside.operators.ntile import tuple_after
    rows = [(None, 1), (None, 5), (1, None), (1, 3), (2, 0)]
    df = spark.createDataFrame(rows, "a int, b int")
    def after(values):
        return [tuple(r) for r in df.where(tuple_after(["a", "b"], values)).collect()]
    assert set(after((None, 1))) == {(None, 5), (1, None), (1, 3), (2, 0)}   # NULL sorts first
    assert set(after((1, None))) == {(1, 3), (2, 0)}
    assert set(after((1, 3))) == {(2, 0)}
    assert after((2, 0)) == []
