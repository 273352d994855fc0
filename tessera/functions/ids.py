"""Body ids: a group number in the upper and a body number in the lower 32 bits of a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF


def pack(group: Column, body: Column) -> Column:
    return F.shiftleft(group.cast("long"), 32).bitwiseOR(body.cast("long").bitwiseAND(F.lit(LOW)))


def group_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def body_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(LOW))


def text_of(packed: Column) -> Column:
    return F.concat(F.lit("("), group_of(packed).cast("string"), F.lit(","), body_of(packed).cast("string"), F.lit(")"))


def order_of(packed: Column) -> Column:
    """Orders as an unsigned 64-bit number would."""
    return F.struct(group_of(packed), body_of(packed))


def pair_key(a: Column, b: Column) -> Column:
    """One key for an unordered pair: (lo, hi) in the order of ``order_of``."""
    first = order_of(a) <= order_of(b)
    return F.struct(F.when(first, a).otherwise(b).alias("lo"), F.when(first, b).otherwise(a).alias("hi"))
