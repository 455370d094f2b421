"""What the operators need of the session: the shared folder, cut lineage, batch sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, as in tests, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder: lost executors can't take it along.

    The files go when the frame is no longer used, where the session asks for that
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, removed when the driver ends (``drop`` removes it sooner)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        if not _made:
            atexit.register(lambda: [shutil.rmtree(x, ignore_errors=True) for x in _made])
        _made.append(local)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme: one without is on the cluster's default file system, not a local disk."""
    fs, p = _hadoop(spark, path)
    out = fs.makeQualified(p).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read, on any file system."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds: by rows, and by bytes for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def column_or_null(df: DataFrame, name: str, kind: str):
    """``df[name]``, or a null of that type if the frame has no such column."""
    from pyspark.sql import functions as F

    return df[name] if name in df.columns else F.lit(None).cast(kind)
