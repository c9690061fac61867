"""Tables written to the folder that driver and executors share, where a plan must be cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[list[str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the session; a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="auxograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: what is computed from it later sees one version of it, and loses no more than its own tasks."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def deleted_after(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that are made in this block at its end, for a caller that has written its results by then."""
    _written.append([])
    try:
        yield
    finally:
        delete(spark, *_written.pop())
