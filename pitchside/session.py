"""Session construction and the shared checkpoint location.

Everything here is ordinary Spark configuration. The library never assumes a
particular cluster: it reads ``spark.checkpoint.dir`` from the running session
and only falls back to a private scratch directory when that setting is unset
(local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (its
# broadcast conversion is size-checked by construction), coalesces small
# shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files (NTILE inputs, cleaned season rows) are deleted once their
    # DataFrames are garbage collected, instead of piling up in the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pitchside", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's base settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``; only when it is unset on one machine
    (tests) a private scratch directory is created and registered. On a cluster
    other machines would not see such a folder, so there the setting is required.
    """
    try:
        sc = spark.sparkContext
    except Exception:          # a Spark Connect session: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not path:
        path = tempfile.mkdtemp(prefix="pitchside-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint root for a written intermediate table."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a write's shuffle files go when the write ends: nothing reads them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: every reader of it takes only its columns.

    A column store keeps rows of repeated texts and small numbers in a tenth of the space of a checkpoint.
    """
    return written_in_turns([df], name)


def written_in_turns(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """The rows of all ``parts`` as one such table: they are written one after the other, and the shuffles of one are gone before the next begins."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    for df in parts:
        with shuffles_dropped(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    table = spark.read.schema(parts[0].schema).parquet(path)
    table.written_path = path
    return table


def drop_written(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing reads it any more; any other frame is left alone."""
    path = getattr(table, "__dict__", {}).get("written_path")
    if path:
        delete_path(table.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its filesystem (HDFS, object store or local), via Hadoop's FileSystem API."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own tables, on any filesystem; nothing if it is not there."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    if not path_exists(spark, path):
        return []
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath))


def create_text(spark: SparkSession, path: str, line: str) -> bool:
    """Create a small file of one line; False if it exists already, which leaves it as it is."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(hpath, False)
    except Py4JJavaError as e:
        if fs.exists(hpath):
            return False
        raise e
    writer = jvm.java.io.OutputStreamWriter(out, "UTF-8")
    try:
        writer.write(line + "\n")
    finally:
        writer.close()
    return True


def read_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a small file."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hpath)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its filesystem, as file names in rows have it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hpath).toString()
