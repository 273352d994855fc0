"""kd-trees as tables: built by exact medians, packed into arrays, written, read back and descended.

Nodes are numbered as in a heap: the root is 1, the halves of k are 2 k and 2 k + 1; axes take turns from x, and a point
goes to the upper half where it isn't below the cut. A node without points is cut in the middle of its box.

The upper levels are cut one by one, by exact quantiles that no task gathers (see ``selection``). As soon as no node holds
more than ``FEW`` points, one pass builds all that is below inside tasks.

A packed tree has a row for each root of a stretch of ``STRETCH`` levels, whose cuts lie in an array; a point walks down
such a stretch in one expression of constant size, and joins the next by the node that it has reached.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .selection import quantiles

#: Points of a node that one task takes, and levels of a stretch: its cuts, 2**levels doubles, stay in one row.
FEW, STRETCH = 1 << 16, 12

AXES = ["x", "y", "z"]
NODES = "node long, level int, axis int, cut double, min array<double>, max array<double>, points long"


def _axis(level: int) -> str:
    return AXES[level % 3]


def _halves(nodes: DataFrame, level: int) -> DataFrame:
    """The boxes of the next level's nodes."""
    i = level % 3
    put = lambda box: F.transform(F.col(box), lambda x, k: F.when(k == i, F.col("cut")).otherwise(x))
    lower = F.struct((F.col("node") * 2).alias("node"), F.col("min").alias("min"), put("max").alias("max"))
    upper = F.struct((F.col("node") * 2 + 1).alias("node"), put("min").alias("min"), F.col("max").alias("max"))
    return nodes.select(F.explode(F.array(lower, upper)).alias("n")).select("n.*")


def _below(levels: int, first: int):
    """Builds what lies below a node of level ``first`` from its points and its box."""

    def build(key: tuple, points: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        xyz = points[AXES].to_numpy()
        todo, out = [(int(key[0]), first, np.arange(len(xyz)), np.array(box["min"].iloc[0]), np.array(box["max"].iloc[0]))], []
        while todo:
            node, level, at, low, high = todo.pop()
            if level == levels:
                out.append((node, level, None, None, low, high, len(at)))
                continue
            i = level % 3
            middle = float(np.quantile(xyz[at, i], 0.5)) if len(at) else (low[i] + high[i]) / 2
            out.append((node, level, i, middle, low, high, len(at)))
            above = xyz[at, i] >= middle
            upper, lower = high.copy(), low.copy()
            upper[i] = lower[i] = middle
            todo += [(2 * node, level + 1, at[~above], low, upper), (2 * node + 1, level + 1, at[above], lower, high)]
        return pd.DataFrame(out, columns=["node", "level", "axis", "cut", "min", "max", "points"]).astype({"axis": "Int32", "points": "int64"})

    return build


def build(points: DataFrame, levels: int) -> DataFrame:
    """Rows of ``NODES`` for all nodes of ``levels`` levels of cuts; the leaves have no axis and no cut. Points need x, y, z; nulls are left out."""
    placed = cut(points.select(*(F.col(c).cast("double").alias(c) for c in AXES)).dropna().withColumn("node", F.lit(1).cast("long")))
    nodes = placed.groupBy("node").agg(F.array(*(F.min(c) for c in AXES)).alias("min"), F.array(*(F.max(c) for c in AXES)).alias("max"))
    done: list[DataFrame] = []
    for level in range(levels + 1):
        counts = placed.groupBy("node").agg(F.count(F.lit(1)).alias("points"))
        nodes = nodes.join(counts, "node", "left").withColumn("points", F.coalesce("points", F.lit(0)))
        if level == levels:
            done.append(nodes.select("node", F.lit(level).alias("level"), F.lit(None).cast("int").alias("axis"), F.lit(None).cast("double").alias("cut"), "min", "max", "points"))
            break
        nodes = cut(nodes)
        if nodes.where(F.col("points") > FEW).isEmpty():
            rest = placed.groupBy("node").cogroup(nodes.groupBy("node")).applyInPandas(_below(levels, level), NODES)
            done.append(rest)
            break
        axis = _axis(level)
        cuts = quantiles(placed, ["node"], axis, [0.5]).select("node", F.col("quantiles")[0].alias("cut"))
        middle = (F.col("min")[level % 3] + F.col("max")[level % 3]) / 2
        nodes = cut(nodes.join(cuts, "node", "left").withColumn("cut", F.coalesce("cut", middle)))
        done.append(nodes.select("node", F.lit(level).alias("level"), F.lit(level % 3).alias("axis"), "cut", "min", "max", "points"))
        placed = cut(placed.join(nodes.select("node", "cut"), "node").withColumn("node", 2 * F.col("node") + (F.col(axis) >= F.col("cut")).cast("int")).drop("cut"))
        nodes = _halves(nodes, level)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(nodes: DataFrame) -> DataFrame:
    """root, first (its level), levels and cuts (in heap order from 1) of each stretch: at most 2**``STRETCH`` cuts a row."""
    inner = nodes.where("cut is not null")
    first = F.col("level") - F.col("level") % STRETCH
    root = F.expr(f"shiftright(node, level % {STRETCH})")
    within = F.expr(f"node - shiftleft(shiftright(node, level % {STRETCH}) - 1, level % {STRETCH})")
    rows = inner.select(root.alias("root"), first.alias("first"), F.expr(f"level % {STRETCH}").alias("depth"), within.alias("place"), "cut")
    packed = rows.groupBy("root", "first").agg((F.max("depth") + 1).alias("levels"), F.array_sort(F.collect_list(F.struct("place", "cut"))).alias("all"))
    return packed.select("root", "first", "levels", F.transform("all", lambda x: x["cut"]).alias("cuts"))


def unpack(packed: DataFrame) -> DataFrame:
    """node, level, axis and cut of each inner node."""
    each = packed.select("root", "first", F.posexplode("cuts").alias("at", "cut")).withColumn("place", F.col("at") + 1)
    depth = F.floor(F.log2("place")).cast("int")
    return each.withColumn("depth", depth).select(
        (F.expr("shiftleft(root, depth)") + F.col("place") - F.expr("shiftleft(1L, depth)")).alias("node"), (F.col("first") + F.col("depth")).cast("int").alias("level"),
        ((F.col("first") + F.col("depth")) % 3).cast("int").alias("axis"), "cut",
    )


def walk(first: Column, levels: Column, cuts: Column, start: Column) -> Column:
    """The node that the point (x, y, z) reaches from ``start`` over ``levels`` levels."""
    point = F.array(*map(F.col, AXES))

    def step(s: Column, depth: Column) -> Column:
        above = F.get(point, (first + depth) % 3) >= F.get(cuts, s - 1)
        return 2 * s + above.cast("int")

    steps = F.sequence(F.lit(0), levels - 1)
    ended = F.aggregate(steps, F.lit(1), step)
    # From the place inside the stretch to the number in the whole tree.
    wide = F.pow(F.lit(2), levels).cast("long")
    return start * wide + ended - wide


def descend(points: DataFrame, packed: DataFrame, levels: int, column: str = "leaf") -> DataFrame:
    """``points`` with the index of their leaf, from 0. Each stretch is a join by node: the first has one row, which every task gets."""
    tree = packed.select(F.col("root").alias("_node"), F.col("first").alias("_first"), F.col("levels").alias("_levels"), F.col("cuts").alias("_cuts"))
    at = points.withColumn("_node", F.lit(1).cast("long"))
    for first in range(0, levels, STRETCH):
        own = tree.where(F.col("_first") == first)
        own = F.broadcast(own) if first == 0 else own
        at = at.join(own, "_node").withColumn("_node", walk(F.col("_first"), F.col("_levels"), F.col("_cuts"), F.col("_node"))).drop("_first", "_levels", "_cuts")
    return at.withColumn(column, F.col("_node") - (1 << levels)).drop("_node")
