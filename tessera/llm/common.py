"""Helpers shared by the corpus operators: scratch tables in the shared folder, and column access by name."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by sessions on one machine that name no shared folder (local runs and tests).
LOCAL_SCRATCH = "/tmp/checkpoints"

#: A key of every row, as ids may be null or repeat.
ROW = "_tessera_row"


class Scratch:
    """Tables written while it is entered; ``release`` deletes them, and no others."""

    _entered: list[Scratch] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._entered.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._entered.pop()

    def release(self, spark: SparkSession) -> int:
        """Call it only when all results that came from these tables have been written."""
        n = len(self.paths)
        while self.paths:
            delete(spark, self.paths.pop())
        return n


#: What is written outside any other stays until its owner releases it.
SESSION = Scratch()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a local one only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{LOCAL_SCRATCH}/{os.getpid()}").rstrip("/")


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it read back.

    This cuts the lineage: work that follows restarts from committed files when an executor is lost, and adaptive
    joins see an exchange on either side, so that they can split skewed partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    (Scratch._entered[-1] if Scratch._entered else SESSION).paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own in each row, ``ROW``: written, so that all later reads see the same numbers."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    """The text column, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
