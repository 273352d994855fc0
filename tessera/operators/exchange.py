"""What processes that share a scene send each other: bodies that move, replicas at borders, and kinds of messages, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import cells_overlapped, with_cell

# Kinds of messages and their flags.
MESSAGES = {
    "generic": 1 << 0, "text": 1 << 1, "body": 1 << 2, "external contacts": 1 << 3, "split body factor": 1 << 4, "split body update": 1 << 5,
    "split body solution": 1 << 6, "point gather": 1 << 7, "builder results": 1 << 8,
}


def migrations(bodies: DataFrame, dt: float, low: tuple, width: tuple, cells: tuple) -> DataFrame:
    """id, from_cell, to_cell of the bodies (x, y, z, vx, vy, vz) whose owner changes within ``dt``."""
    now = with_cell(bodies, low, width, cells).withColumnRenamed("cell_id", "from_cell").drop("ix", "iy", "iz")
    moved = with_cell(now.withColumns({c: F.col(c) + F.col(f"v{c}") * dt for c in "xyz"}), low, width, cells)
    return moved.where("cell_id <> from_cell").select("id", "from_cell", F.col("cell_id").alias("to_cell"))


def replicas(bodies: DataFrame, low: tuple, width: tuple, cells: tuple) -> DataFrame:
    """id, owner_cell, cell_id: a remote copy for each cell but the owner's that a body's box meets."""
    return cells_overlapped(bodies, low, width, cells).where("not is_owner").select("id", "owner_cell", "cell_id")


def messages(moves: DataFrame, copies: DataFrame) -> DataFrame:
    """sender, receiver, flags (the kinds that go between them) and bodies: moved ones and replicas, summed per pair of cells."""
    moved = moves.select(F.col("from_cell").alias("sender"), F.col("to_cell").alias("receiver"), F.lit(MESSAGES["body"]).alias("flag"))
    shared = copies.select(F.col("owner_cell").alias("sender"), F.col("cell_id").alias("receiver"), F.lit(MESSAGES["split body factor"]).alias("flag"))
    return moved.unionByName(shared).groupBy("sender", "receiver").agg(F.bit_or("flag").alias("flags"), F.count(F.lit(1)).alias("bodies"))
