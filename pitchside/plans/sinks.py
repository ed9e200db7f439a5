"""Result sinks.

The reference serialises each result set as a JSON array for its page. Here a
result is written as JSON Lines by the executors (one file per task, no
collect), or turned into one JSON document per row inside Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; a NULL column keeps its key, with the value null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row, keyed by column alias (the reference's row objects)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(column))
