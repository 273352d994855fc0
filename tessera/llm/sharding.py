"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

A key walks through a sequence of buckets drawn from its own linear congruential generator; the last bucket below the
shard count is its shard. With one more shard, a key either stays or moves to the new shard. No ring table exists, so
nothing has to be stored, sent or kept in step.

Defined cases: a null key counts as key 0; a null text has size 1 and checksum 0; repeated rows get slots of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_or_empty

# The generator's multiplier and increment, as published with the algorithm.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

#: A key jumps about ln(n) times: 22 on average even for 2**31 shards, and more than 128 times with a chance below 1e-50;
#: such a key would fail the job, not get a wrong shard.
MOST_JUMPS = 128

_MASK32 = 0xFFFFFFFF
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & _MASK32


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """One generator step modulo 2**64 on unsigned 32-bit halves; no product reaches 2**63, so ANSI mode has nothing to raise."""
    m_high, m_low, mask16, mask32 = (F.lit(x).cast("long") for x in (_M_HIGH, _M_LOW, 0xFFFF, _MASK32))
    bottom = low.bitwiseAND(mask16) * m_low + F.lit(INCREMENT)
    middle = F.shiftright(low, 16) * m_low + F.shiftrightunsigned(bottom, 16)
    new_low = F.shiftleft(middle.bitwiseAND(mask16), 16).bitwiseOR(bottom.bitwiseAND(mask16))
    from_high = high.bitwiseAND(mask16) * m_low + F.shiftleft((F.shiftright(high, 16) * m_low).bitwiseAND(mask16), 16)
    new_high = (F.shiftrightunsigned(middle, 16) + (low * m_high).bitwiseAND(mask32) + from_high.bitwiseAND(mask32)).bitwiseAND(mask32)
    return new_high, new_low


def jump_shards(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard of ``key`` among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def step(s: Column, _: Column) -> Column:
        high, low = _next_state(s["high"], s["low"])
        bucket = s["jump"]
        jump = F.floor((bucket + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        live = bucket <= shards
        return F.struct(
            F.when(live, high).otherwise(s["high"]).alias("high"),
            F.when(live, low).otherwise(s["low"]).alias("low"),
            F.when(live, jump).otherwise(bucket).alias("jump"),
            F.when(bucket < shards, bucket).otherwise(s["shard"]).alias("shard"),
            F.when(live, bucket).otherwise(s["grown"]).alias("grown"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_MASK32).cast("long")).alias("low"),
        zero.alias("jump"),
        zero.alias("shard"),
        zero.alias("grown"),
    )
    steps = F.sequence(F.lit(1), F.lit(min(shards + 1, MOST_JUMPS)))
    found = lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))
    return F.aggregate(steps, start, step, lambda s: F.when(s["jump"] > shards, found(s)).otherwise(F.raise_error(F.lit("a key jumps too often"))))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, size, checksum and slot of every row.

    The texts are read once and leave the scan as a few numbers. Slots are numbered in two levels: rows are dealt to
    about sqrt(n) buckets by hash, counted, and numbered inside a bucket behind the counts of the buckets before it, so
    that no task holds a shard, nor the rows that repeat one key.
    """
    text = text_or_empty(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            jump_shards(F.col(id_col), shards).alias("at"),
        ).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), F.monotonically_increasing_id().alias("row")),
        "shards",
    )
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard",
        )
    )
