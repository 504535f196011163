"""The folder that driver and executors share, tables in it, and how to empty it again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where that is unset, the context's
    checkpoint folder, else a temporary one, in local mode only: on a cluster each
    executor would write to a disk of its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        set_to = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def passing_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver exits."""
    if not _made:
        atexit.register(_drop_made)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _drop_made() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone already; nothing left to tidy with
            return


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table and read again: lost executors cost a reread."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def finer_scans(spark: SparkSession, tasks_a_core: int = 4) -> Iterator[None]:
    """Scans are cut to more tasks meanwhile, so that costly ones end together."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(tasks_a_core * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
