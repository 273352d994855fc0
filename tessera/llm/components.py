"""Connected components by contraction, in DataFrame operations: links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b); component is the least id in it.

    Each round joins every vertex to the neighbour, or itself, of least priority. Priorities are ids at first, which ends a
    star about its least vertex at once, and every other round drawn anew, so that two rounds remove a constant share of
    the vertices whatever their order. Round tables are written to the shared
    folder; joins have an exchange on either side, so that a vertex with very many links can be split.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        drawn = F.lit(0).cast("long") if turn < 2 or turn % 2 else None
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(turn)) if drawn is None else drawn).alias("p"), F.col(c).alias("id"))  # noqa: E731, B023
        parents = materialise(
            both(edges).groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("id"), F.least(rank("a"), "near")["id"].alias("parent")),
            "parents",
        )
        as_a = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        as_b = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        edges = materialise(
            edges.join(as_a, "a").join(as_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        labels = _moved(labels, parents)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = materialise(labels.groupBy("root").agg(F.min("id").alias("component")), "least")
    return labels.join(least, "root").select("id", "component")


def _moved(labels: DataFrame | None, parents: DataFrame) -> DataFrame:
    if labels is None:
        return parents.select("id", F.col("parent").alias("root"))
    moved = parents.select(F.col("id").alias("root"), "parent")
    return materialise(labels.join(moved, "root", "left").select("id", F.coalesce("parent", "root").alias("root")), "labels")
