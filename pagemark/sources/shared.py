"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession, prefix: str = "shared-") -> str:
    """The session's spark.checkpoint.dir; on one machine, where that is not set, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix=prefix)
    return shared


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in it."""
    return f"{shared_root(spark, 'queries-')}/{name}-{uuid.uuid4()}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written there, so that no lost executor makes earlier rounds run again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession, "checkpoint-"))
    return df.checkpoint()


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks df is dealt to, so that each gets about so many rows whatever the size of the table; every core has one at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system, and the path in it, of a path or URI as Spark writes it; for files that Spark's own writers do not make."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
