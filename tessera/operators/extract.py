"""Several extractors over one scan: grids and kd-trees of their own, each with its quantities.

Each point becomes a row for every extractor that holds it, and one aggregation by extractor and cell, with partial
results in the tasks that read the points, gives all of them. Quantities that extractors share are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kdtree

#: What a quantity may be, of a column.
QUANTITIES = {"sum": F.sum, "mean": F.avg, "least": F.min, "greatest": F.max}
AXES = ["x", "y", "z"]


@dataclass(frozen=True)
class Grid:
    """Cells of a width from ``low``; quantities by name as (kind, column), ``count`` comes always. Points outside don't count."""

    name: str
    low: tuple[float, float, float]
    width: tuple[float, float, float]
    size: tuple[int, int, int]
    quantities: dict[str, tuple[str, str]]

    def cell(self) -> Column:
        at = [F.floor((F.col(c) - low) / w).cast("long") for c, low, w in zip(AXES, self.low, self.width)]
        inside = at[0].between(0, self.size[0] - 1) & at[1].between(0, self.size[1] - 1) & at[2].between(0, self.size[2] - 1)
        return F.when(inside, at[0] + self.size[0] * (at[1] + self.size[1] * at[2]))


@dataclass(frozen=True)
class Tree:
    """Leaves of a packed kd-tree (see ``kdtree``) of one stretch of levels."""

    name: str
    packed: DataFrame
    quantities: dict[str, tuple[str, str]]


def extract(points: DataFrame, extractors: list[Grid | Tree]) -> DataFrame:
    """extractor, cell, count, and a column for each quantity, null where an extractor doesn't have it."""
    asked: dict[str, tuple[str, str]] = {}
    for e in extractors:
        for name, (kind, column) in e.quantities.items():
            if kind not in QUANTITIES or asked.setdefault(name, (kind, column)) != (kind, column):
                raise ValueError(f"{name} of {e.name} is unknown or has another meaning elsewhere")
    if len({e.name for e in extractors}) < len(extractors):
        raise ValueError("two extractors have one name")
    columns = list(dict.fromkeys([*AXES, *(c for _, c in asked.values())]))
    rows, cells = points.select(*columns), []
    for i, e in enumerate(extractors):
        if isinstance(e, Tree):
            one = e.packed.where("root = 1").select(*(F.col(c).alias(f"_{c}{i}") for c in ("levels", "cuts")))
            rows = rows.join(F.broadcast(one))  # one row of a stretch at most
            cell = kdtree.walk(F.lit(0), F.col(f"_levels{i}"), F.col(f"_cuts{i}"), F.lit(1)) - F.pow(F.lit(2), F.col(f"_levels{i}")).cast("long")
        else:
            cell = e.cell()
        cells.append(F.struct(F.lit(e.name).alias("extractor"), cell.alias("cell")))
    each = rows.select(*columns, F.explode(F.filter(F.array(*cells), lambda c: c["cell"].isNotNull())).alias("_c"))
    wants = {name: F.col("_c.extractor").isin([e.name for e in extractors if name in e.quantities]) for name in asked}
    found = [QUANTITIES[kind](F.when(wants[name], F.col(column))).alias(name) for name, (kind, column) in asked.items()]
    return each.groupBy("_c.extractor", "_c.cell").agg(F.count(F.lit(1)).alias("count"), *found)
