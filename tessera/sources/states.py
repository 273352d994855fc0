"""The state store: body states as a partitioned table, with layout checks, and a binary format for exchange."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binary


def schema(nq: int = 7, nu: int = 6) -> T.StructType:
    """Rows of a store whose states have ``nq`` positions and ``nu`` velocities a body."""
    vector = T.ArrayType(T.DoubleType())
    return T.StructType(
        [
            T.StructField("sim_id", T.StringType()), T.StructField("state_nr", T.LongType()), T.StructField("t", T.DoubleType()),
            T.StructField("body_id", T.LongType()), T.StructField("q", vector, metadata={"size": nq}), T.StructField("u", vector, metadata={"size": nu}),
        ]
    )


def checked(states: DataFrame, nq: int = 7, nu: int = 6) -> DataFrame:
    """The same rows; one with another layout fails the job."""
    fits = (F.size("q") == nq) & (F.size("u") == nu)
    return states.withColumn("q", F.when(fits, F.col("q")).otherwise(F.raise_error(F.lit("a state has another layout"))))


def write(states: DataFrame, path: str, mode: str = "errorifexists", nq: int = 7, nu: int = 6) -> None:
    checked(states, nq, nu).write.mode(mode).partitionBy("sim_id").parquet(path)


def read(spark: SparkSession, *paths: str, nq: int = 7, nu: int = 6) -> DataFrame:
    """States of all stores; each is partitioned by itself, so they are read apart."""
    stores = [spark.read.schema(schema(nq, nu)).parquet(p) for p in paths]
    return checked(functools.reduce(DataFrame.unionByName, stores), nq, nu)


def append(states: DataFrame, path: str, nq: int = 7, nu: int = 6) -> bool:
    """Adds states to a store of the same layout; False, and nothing written, where the layout differs."""
    spark = states.sparkSession
    first = spark.read.schema(schema(nq, nu)).parquet(path).select(F.size("q"), F.size("u")).first()
    if first is not None and tuple(first) != (nq, nu):
        return False
    write(states, path, "append", nq, nu)
    return True


# Our own exchange format, little-endian: header (magic, bodies, nq, nu), then per state t and per body id, q, u.
MAGIC = b"TSST"
_HEADER = "<4sQII"


def to_binary(states: list[tuple[float, list[tuple[int, list[float], list[float]]]]], nq: int = 7, nu: int = 6) -> bytes:
    out = [struct.pack(_HEADER, MAGIC, len(states[0][1]) if states else 0, nq, nu)]
    body = struct.Struct(f"<q{nq + nu}d")
    for t, bodies in states:
        out += [struct.pack("<d", t), *(body.pack(i, *q, *u) for i, q, u in bodies)]
    return b"".join(out)


def read_binary(spark: SparkSession, path: str, nq: int = 7, nu: int = 6) -> DataFrame:
    """States of all files under ``path`` in the exchange format; a header that doesn't fit fails the job. Files are the unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = struct.Struct(f"<q{nq + nu}d")
        names = ["sim_id", "state_nr", "t", "body_id", "q", "u"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(raw.as_buffer())
                magic, bodies, q, u = struct.unpack_from(_HEADER, view)
                if (magic, q, u) != (MAGIC, nq, nu):
                    raise ValueError(f"{file} has another layout")
                at, number, size = struct.calcsize(_HEADER), 0, 8 + bodies * body.size
                while at + size <= len(view):
                    (t,) = struct.unpack_from("<d", view, at)
                    rows = [body.unpack_from(view, at + 8 + k * body.size) for k in range(bodies)]
                    columns = [[file] * bodies, [number] * bodies, [t] * bodies, [r[0] for r in rows], [list(r[1 : 1 + nq]) for r in rows], [list(r[1 + nq :]) for r in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                    at, number = at + size, number + 1
                if at != len(view):
                    raise ValueError(f"{file} ends inside a state")

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema(nq, nu))


def read_matrices(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """file, matrix: contiguous little-endian doubles by column; a file that ends inside a matrix fails the job."""
    found = binary.read_records(spark, path, f"m:f8[{rows * columns}]")
    return found.select("file", F.array(*(F.array(*(F.col("m")[j * rows + i] for j in range(columns))) for i in range(rows))).alias("matrix"))


def catalog(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Files under ``path``: path, length, modificationTime, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")
