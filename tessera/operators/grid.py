"""Grid cells and kd-trees as partitions of space, and aggregates per cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def cell_index(v: Column, low: float, width: float, cells: int) -> Column:
    """Index of the cell that holds ``v``, clamped to the grid."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(cells - 1).cast("long"), F.floor((v - low) / width)))


def with_cell(bodies: DataFrame, low: tuple, width: tuple, cells: tuple) -> DataFrame:
    """Adds ix, iy, iz and cell_id."""
    at = {f"i{c}": cell_index(F.col(c), l, w, n) for c, l, w, n in zip("xyz", low, width, cells)}
    return bodies.withColumns(at).withColumn("cell_id", F.col("ix") + cells[0] * (F.col("iy") + cells[1] * F.col("iz")))


def per_cell(bodies: DataFrame, low: tuple, width: tuple, cells: tuple, quantities: dict[str, Column]) -> DataFrame:
    """One row per occupied cell: count and the given aggregates, all from one pass."""
    return with_cell(bodies, low, width, cells).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("bodies"), *(c.alias(k) for k, c in quantities.items()))


def bounds(bodies: DataFrame) -> DataFrame:
    """Smallest and largest coordinate on each axis."""
    return bodies.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def cells_overlapped(bodies: DataFrame, low: tuple, width: tuple, cells: tuple) -> DataFrame:
    """A row for each cell that the bounding box of a sphere meets, with ``is_owner`` for the one that holds its centre.

    The cells follow from arithmetic, so that no join is needed; a body meets as many as its size asks for.
    """
    out = with_cell(bodies, low, width, cells).withColumnRenamed("cell_id", "owner_cell")
    for c, l, w, n in zip("xyz", low, width, cells):
        first, last = (cell_index(e, l, w, n) for e in (F.col(c) - F.col("r"), F.col(c) + F.col("r")))
        out = out.withColumn(f"j{c}", F.explode(F.sequence(first, last)))
    out = out.withColumn("cell_id", F.col("jx") + cells[0] * (F.col("jy") + cells[1] * F.col("jz")))
    return out.withColumn("is_owner", F.col("cell_id") == F.col("owner_cell")).drop("jx", "jy", "jz")


def split_weights(parts: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds multiplicity (rows of the body) and weight (its inverse)."""
    counts = parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("multiplicity"))
    return parts.join(counts, id_col).withColumn("weight", F.lit(1.0) / F.col("multiplicity"))


def weigh(h: Column, inverse_mass: Column, weight: Column) -> tuple[Column, Column]:
    """Forces and inverse masses of one part of a split body."""
    return F.transform(h, lambda x: x * weight), F.transform(inverse_mass, lambda x: x / weight)


def to_split(parts: DataFrame) -> DataFrame:
    """Whole bodies (multiplicity 1, h, inverse_mass) with their ``parts`` and ``part_weight`` as split ones; another multiplicity fails the job."""
    whole = F.when(F.col("multiplicity") == 1, F.col("parts")).otherwise(F.raise_error(F.concat(F.lit("a body has multiplicity "), F.col("multiplicity").cast("string"))).cast("long"))
    h, inverse = weigh(F.col("h"), F.col("inverse_mass"), F.col("part_weight"))
    return parts.select(*(c for c in parts.columns if c not in ("multiplicity", "h", "inverse_mass", "parts", "part_weight")), whole.alias("multiplicity"), F.col("part_weight").alias("weight"), h.alias("h"), inverse.alias("inverse_mass"))


def to_whole(parts: DataFrame, inverse_mass: Column) -> DataFrame:
    """The way back: forces without their weight, the inverse masses anew from ``inverse_mass``; a body that isn't split fails the job."""
    split = F.when(F.col("multiplicity") != 1, F.lit(1).cast("long")).otherwise(F.raise_error(F.lit("a body has multiplicity 1")).cast("long"))
    rest = [c for c in parts.columns if c not in ("multiplicity", "weight", "h", "inverse_mass")]
    # In a step of its own: inside a function ``weight`` would be the new one.
    freed = parts.withColumn("h", F.transform("h", lambda x: x / F.col("weight")))
    return freed.select(*rest, split.alias("multiplicity"), F.lit(1.0).alias("weight"), "h", inverse_mass.alias("inverse_mass"))


def stale_removed(neighbours: DataFrame) -> DataFrame:
    """Bodies that are still in a neighbour's map, their overlap flags cleared."""
    return neighbours.where("in_neighbour_map").withColumn("overlaps", F.lit(False))


def kd_tree(points: DataFrame, levels: int, error: float | None = 0.001) -> list[dict]:
    """Leaves of a kd-tree by medians: cell_id, level, idx, min, max. Axes take turns from x.

    One pass a level splits all its nodes at once, by approximate medians of bounded ``error``, or exact ones where it is
    None (then a node's distinct values must fit a task); the driver holds the 2**levels boxes alone.
    """
    box = points.agg(*(F.min(c) for c in "xyz"), *(F.max(c) for c in "xyz")).first()
    if box is None or box[0] is None:
        return []
    leaves = [{"level": 0, "idx": 0, "min": list(box[:3]), "max": list(box[3:])}]
    for level in range(levels):
        axis = level % 3
        placed = assign_leaf(points, leaves)
        median = F.percentile("xyz"[axis], 0.5) if error is None else F.percentile_approx("xyz"[axis], 0.5, int(1 / error))
        found = placed.groupBy("leaf").agg(median.alias("cut")).collect()  # one number a leaf
        cuts = {r["leaf"]: r["cut"] for r in found}
        split = []
        for leaf in leaves:
            cut_at = cuts.get(leaf["idx"], (leaf["min"][axis] + leaf["max"][axis]) / 2)
            upper = [*leaf["max"]]
            lower = [*leaf["min"]]
            upper[axis] = lower[axis] = cut_at
            split += [
                {"level": level + 1, "idx": 2 * leaf["idx"], "min": leaf["min"], "max": upper},
                {"level": level + 1, "idx": 2 * leaf["idx"] + 1, "min": lower, "max": leaf["max"]},
            ]
        leaves = split
    return [{"cell_id": leaf["idx"], **leaf} for leaf in leaves]


def assign_leaf(points: DataFrame, leaves: list[dict]) -> DataFrame:
    """Adds ``leaf``: the index of the leaf that holds the point, by walking the cuts down."""
    levels = leaves[0]["level"]

    def walk(nodes: list[dict], level: int) -> Column:
        if len(nodes) == 1:
            return F.lit(nodes[0]["idx"])
        half = len(nodes) // 2
        axis = level % 3
        cut = nodes[half]["min"][axis]
        return F.when(F.col("xyz"[axis]) < cut, walk(nodes[:half], level + 1)).otherwise(walk(nodes[half:], level + 1))

    assert len(leaves) == 1 << levels
    return points.withColumn("leaf", walk(leaves, 0))


_POSITION = ["x", "y", "z"]


def nearest_distance(bodies: DataFrame, cell: float | None = None) -> DataFrame:
    """id and distance to the nearest other body, for all bodies but a single one.

    Bodies that share a place have distance 0. The others look through the cells around their own; what is found within
    a cell's width is proven, the rest looks again with cells of twice the width. Cells start below the mean spacing.
    """
    placed = cut(bodies.groupBy(*_POSITION).agg(F.collect_list("id").alias("ids")))
    done = placed.where(F.size("ids") > 1).select(F.explode("ids").alias("id"), F.lit(0.0).alias("distance"))
    n, *box = placed.agg(F.count(F.lit(1)), *(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    if n < 2:
        return done
    sides = [high - low for low, high in zip(box[::2], box[1::2])]
    extent = max(sides)
    if cell is None:
        cell = max(math.prod(max(s, extent / n) for s in sides) / n, 0.0) ** (1 / 3) / 2 or extent
    pending = placed.where(F.size("ids") == 1).select(F.col("ids")[0].alias("id"), *_POSITION)
    near = F.sequence(F.lit(-1), F.lit(1))
    while True:
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        others = placed.select(*_POSITION, *(at(c).alias(f"c{c}") for c in "xyz"))
        around = pending.select("id", *(F.col(c).alias(f"{c}_a") for c in "xyz"), *(at(c).alias(f"a{c}") for c in "xyz"))
        for c in "xyz":
            around = around.withColumn("_d", F.explode(near)).withColumn(f"c{c}", F.col(f"a{c}") + F.col("_d")).drop("_d", f"a{c}")
        d2 = sum(((F.col(c) - F.col(f"{c}_a")) * (F.col(c) - F.col(f"{c}_a")) for c in "xyz"), F.lit(0.0))
        itself = (F.col("x") == F.col("x_a")) & (F.col("y") == F.col("y_a")) & (F.col("z") == F.col("z_a"))
        found = around.join(others, ["cx", "cy", "cz"]).where(~itself).groupBy("id").agg(F.sqrt(F.min(d2)).alias("distance"))
        found = found if cell > extent else found.where(F.col("distance") <= cell)
        found = cut(found)
        done = done.unionByName(found)
        if cell > extent:  # the cells around hold all bodies
            return done
        pending = cut(pending.join(found.select("id"), "id", "left_anti"))
        if pending.isEmpty():
            return done
        cell *= 2


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """Counts per bin of ``width``, with mean and population deviation of all values on each row."""
    stats = values.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std_deviation"))
    bins = values.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(stats))  # one row


def minimum_box(points: DataFrame, edges: list[tuple[float, float, float]]) -> DataFrame:
    """The smallest box about ``points`` whose axes come from pairs of ``edges``: the first is an edge, the second the part of
    another that is orthogonal to it. All candidates are measured in one pass; of equal volumes the first pair stays."""
    candidates = []
    for i, a in enumerate(edges):
        for j in range(i + 1, len(edges)):
            u = _unit(a)
            d = sum(p * q for p, q in zip(u, edges[j]))
            v = tuple(q - d * p for p, q in zip(u, edges[j]))
            if math.sqrt(sum(p * p for p in v)) < 1e-12:
                continue
            v = _unit(v)
            w = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
            candidates.append((i, j, u, v, w))
    if not candidates:
        raise ValueError("two edges that aren't parallel are needed")
    along = lambda axis: sum((F.col(c) * p for c, p in zip("xyz", axis)), F.lit(0.0))
    wide = points.agg(*(f(along(axis)).alias(f"{n}{k}_{m}") for k, c in enumerate(candidates) for m, axis in enumerate(c[2:]) for n, f in (("lo", F.min), ("hi", F.max))))
    boxes = F.array(
        *(
            F.struct(
                (F.col(f"hi{k}_0") - F.col(f"lo{k}_0")) * (F.col(f"hi{k}_1") - F.col(f"lo{k}_1")) * (F.col(f"hi{k}_2") - F.col(f"lo{k}_2")),
                F.lit(k).alias("pair"),
                F.array(*(F.array(*(F.lit(float(p)) for p in axis)) for axis in c[2:])).alias("axes"),
                F.array(*(F.col(f"lo{k}_{m}") for m in range(3))).alias("low"),
                F.array(*(F.col(f"hi{k}_{m}") for m in range(3))).alias("high"),
            )
            for k, c in enumerate(candidates)
        )
    )
    return wide.select(F.array_min(boxes).alias("box")).select("box.*").toDF("volume", "pair", "axes", "low", "high")


def _unit(v: tuple) -> tuple:
    n = math.sqrt(sum(p * p for p in v))
    return tuple(p / n for p in v)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, the place in insertion order; rows are numbered per range, then shifted by the ranges before."""
    # From a checkpoint: the partitions are named in two places, which must mean the same ones.
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.withColumn("position", F.row_number().over(inside)).join(F.broadcast(counts), "_part").withColumn("position", F.col("position") + F.col("_before")).drop("_part", "_n", "_before")
