"""Shared storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the context, or the one named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster
    an executor could not see it, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named:  # set after the context was made
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named or sc.getCheckpointDir()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies; used on those of :func:`new_dir` when they have been read.
    Checkpoints go with their last reference under
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_dir(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder that is removed at the end."""
    path = new_dir(spark, name)
    try:
        yield path
    finally:
        remove_dir(spark, path)


def set_down(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it from there. For wide rows that are used several times: the files are
    compressed, and each use reads its own columns only, which a checkpoint does not allow."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that a lost executor does not make
    Spark run what is above it a second time."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
