"""Small pieces the operators share: reading a table, ASCII lower-casing, deterministic draws, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that separate words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` would also change accented letters)."""
    return F.translate(col, _UPPER, _UPPER.lower())


def unit_draw(col: Column) -> Column:
    """A fixed draw in [0, 1) for a string, the same on every run and in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, and prunes columns when reread.

    Nothing reads the shuffles of the write again, so their files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)
