"""Cutting lineage and scratch folders, in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one stands in only for sessions on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file:///tmp/checkpoints/{os.getpid()}").rstrip("/")


#: Paths that ``scratch`` gave out and nobody has released.
GIVEN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it stays until ``release``."""
    GIVEN.append(f"{shared_folder(spark)}/tessera-{label}-{uuid.uuid4().hex}")
    return GIVEN[-1]


def release(spark: SparkSession) -> int:
    """Deletes what was written to all paths given out so far. Call it when the results that read them have been used."""
    n = len(GIVEN)
    while GIVEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(GIVEN.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
