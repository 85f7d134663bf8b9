"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skald-"))
    return spark.sparkContext.getCheckpointDir()


_lock, _users, _before = threading.Lock(), 0, None


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile drops its shuffle files as it ends: its result is kept, so nothing reads them again.

    The session's own setting is back when the last of several threads is done.
    """
    global _users, _before
    with _lock:
        if not _users:
            _before = spark.conf.get(FREE, None)
            spark.conf.set(FREE, "true")
        _users += 1
    try:
        yield
    finally:
        with _lock:
            _users -= 1
            if not _users:
                spark.conf.unset(FREE) if _before is None else spark.conf.set(FREE, _before)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; Spark's cleaner drops it with its last use."""
    shared_dir(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new plan, for the setting is read when a plan is made


def scratch(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder (options as for its writer), and its path for drop()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/skald-{name}-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that scratch() wrote."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
