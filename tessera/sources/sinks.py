"""Sinks: state tables, text lines, XML rows and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(rows: DataFrame, value: str, path: str, mode: str = "errorifexists", file_col: str | None = None) -> None:
    """One value a line; with ``file_col`` a folder for each of its values."""
    text = rows.select(F.col(value).cast("string").alias("value"), *([file_col] if file_col else []))
    writer = text.write.mode(mode)
    (writer.partitionBy(file_col) if file_col else writer).text(path)


def xml(rows: DataFrame, path: str, root: str, row: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).format("xml").option("rootTag", root).option("rowTag", row).save(path)


def metrics(contacts: DataFrame) -> DataFrame:
    """Number of contacts and largest overlap, as one row."""
    return contacts.agg(F.count(F.lit(1)).alias("contacts"), F.greatest(F.lit(0.0), F.coalesce(F.max("overlap"), F.lit(0.0))).alias("max_overlap"))


def raw(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file of raw bytes, through the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
