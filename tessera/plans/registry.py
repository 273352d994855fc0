"""Collects queries by name, each with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: parity: the reference's behaviour was read; ours: it is only declared there, the semantics are ours; extension: neither.
STATUS: dict[str, str] = {}

#: Bodies derived from ``part``, as SQL; ``bodies`` gives the same rows.
BODY = """body AS (
  SELECT p_partkey AS id, CAST(p_partkey % 37 AS DOUBLE) AS x, CAST((p_partkey * 7) % 41 AS DOUBLE) AS y,
         CAST((p_partkey * 13) % 43 AS DOUBLE) AS z, CAST(0.2 AS DOUBLE) + CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS r,
         p_brand AS mat, p_partkey // 100 AS group_nr, p_partkey % 100 AS body_nr, CAST(p_size AS DOUBLE) AS mass
  FROM part)"""


def query(sql: str | None = None, status: str = "parity"):
    def put(f):
        QUERIES[f.__name__] = f
        STATUS[f.__name__] = status
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 37).cast("double").alias("x"), (k * 7 % 41).cast("double").alias("y"), (k * 13 % 43).cast("double").alias("z"),
        (F.lit(0.2) + F.col("p_size").cast("double") / F.lit(50.0)).alias("r"), F.col("p_brand").alias("mat"),
        F.floor(k / 100).cast("long").alias("group_nr"), (k % 100).alias("body_nr"), F.col("p_size").cast("double").alias("mass"),
    )
