"""Topology documents: the boxes, points and distances of a domain decomposition, and its grid or kd-tree.

A document has attributes ``type`` (Grid or KdTree), ``buildMode`` and ``time``, and the children ``Description``,
``AABBList`` (rows of a rank and six numbers), ``Points`` (rows of coordinates), ``NearestDistanceHistogram`` (numbers,
with attributes ``mean`` and ``stdDeviation``), and ``Grid`` or ``KdTree``. It is parsed once, by a schema, however many
of its parts are read; parts that nobody reads are pruned. What a document must have and hasn't fails the job by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

_TREE = (
    "struct<_aligned: string, A_IK: string, Root: struct<AABB: string>, Leafs: struct<Leaf: array<struct<_level: int, _idx: int, AABB: string, Points: string>>>, "
    "AABBTree: struct<AABBSubTree: array<struct<_level: int, _VALUE: string>>>>"
)
SCHEMA = (
    "_type string, _buildMode string, _time double, Description map<string, string>, AABBList string, Points string, "
    "NearestDistanceHistogram struct<_mean: double, _stdDeviation: double, _VALUE: string>, "
    f"Grid struct<_aligned: string, Dimension: string, MinPoint: string, MaxPoint: string, A_IK: string>, KdTree {_TREE}"
)


def records(text: Column, width: int | None = None) -> Column:
    """Numbers of each line that holds any: fields are parted by one blank, '#' starts a comment, what isn't a number is NaN.

    All lines have ``width`` fields, or as many as the first; another number fails the job. Null gives no lines.
    """
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.regexp_replace(F.regexp_extract(x, r"^[^#]*", 0), r"^[\s]+|[\s]+$", ""))
    lines = F.transform(F.filter(stripped, lambda x: x != ""), lambda x: F.transform(F.split(x, " "), lambda v: F.coalesce(v.try_cast("double"), F.lit(float("nan")))))
    wanted = F.size(F.get(lines, F.lit(0))) if width is None else F.lit(width)
    return F.when(F.forall(lines, lambda x: F.size(x) == wanted), lines).otherwise(F.raise_error(F.lit("a line has another number of columns")))


def numbers(text: Column) -> Column:
    """All numbers of all lines."""
    return F.flatten(records(text))


def required(value: Column, what: str, kind: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"the document has no {what}")).cast(kind))


def _box(row: Column, at: int = 0) -> tuple[Column, Column]:
    return F.slice(row, at + 1, 3), F.slice(row, at + 4, 3)


def boxes(text: Column) -> Column:
    """Array of ``struct(min, max)``, from six numbers a line."""
    return F.transform(records(text, 6), lambda r: F.struct(_box(r)[0].alias("min"), _box(r)[1].alias("max")))


def _middle(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: (a + b) / 2)


def _matrix(text: Column, what: str) -> Column:
    flat = numbers(required(text, what, "string"))
    flat = F.when(F.size(flat) == 9, flat).otherwise(F.raise_error(F.lit(f"{what} hasn't nine numbers")))
    return F.array(*(F.slice(flat, 3 * i + 1, 3) for i in range(3)))


def _aligned(text: Column, what: str) -> Column:
    return required(text, f"attribute aligned of {what}", "string").isin("true", "True")


def parsed(texts: DataFrame, text_col: str = "xml") -> tuple[DataFrame, list[str]]:
    """``texts`` with the document as column ``_d``, and the names of its other columns."""
    rest = [c for c in texts.columns if c != text_col]
    return texts.select(*rest, F.from_xml(F.col(text_col), SCHEMA, {"mode": "FAILFAST"}).alias("_d")), rest


def topology(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """kind, build_mode, time, description, boxes (rank, min, max), points, distances with mean and std_deviation; an unknown kind fails the job."""
    docs, rest = parsed(texts, text_col)
    kind = required(F.col("_d._type"), "attribute type", "string")
    ranked = F.transform(records(F.col("_d.AABBList"), 7), lambda r: F.struct(r[0].cast("long").alias("rank"), _box(r, 1)[0].alias("min"), _box(r, 1)[1].alias("max")))
    near = F.col("_d.NearestDistanceHistogram")
    return docs.select(
        *rest,
        F.when(kind.isin("Grid", "KdTree"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown topology "), kind))).alias("kind"),
        required(F.col("_d._buildMode"), "attribute buildMode", "string").alias("build_mode"), required(F.col("_d._time"), "attribute time", "double").alias("time"),
        required(F.col("_d.Description"), "Description", "map<string,string>").alias("description"),
        ranked.alias("boxes"), records(F.col("_d.Points")).alias("points"),
        numbers(near["_VALUE"]).alias("distances"), near["_mean"].alias("mean"), near["_stdDeviation"].alias("std_deviation"),
    )


def grid_topology(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """aligned, dimension, min, max, center, matrix, and the quaternion ``rotation`` of grid documents."""
    docs, rest = parsed(texts, text_col)
    grid = lambda p: F.col(f"_d.Grid.{p}")
    point = lambda p: numbers(required(grid(p), p, "string"))
    out = docs.select(
        *rest, _aligned(grid("_aligned"), "Grid").alias("aligned"), F.transform(point("Dimension"), lambda d: d.cast("int")).alias("dimension"),
        point("MinPoint").alias("min"), point("MaxPoint").alias("max"), _matrix(grid("A_IK"), "A_IK").alias("matrix"),
    )
    return out.withColumns({"center": _middle(F.col("min"), F.col("max")), "rotation": V.quaternion_of(F.col("matrix"))})


def tree_topology(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """aligned, min, max and center of the root, matrix, rotation, leaves (level, idx, min, max, points) and subtrees (level to boxes) of kd-tree documents.

    A leaf without points has null there; of subtrees with one level the last stays.
    """
    docs, rest = parsed(texts, text_col)
    tree = lambda p: F.col(f"_d.KdTree.{p}")
    first = lambda text, what: required(F.get(boxes(text), F.lit(0)), what, "struct<min:array<double>,max:array<double>>")
    leaves = F.transform(
        required(tree("Leafs"), "Leafs", "struct<Leaf:array<struct<_level:int,_idx:int,AABB:string,Points:string>>>")["Leaf"],
        lambda x: F.struct(
            required(x["_level"], "attribute level of a Leaf", "int").alias("level"), required(x["_idx"], "attribute idx of a Leaf", "int").alias("idx"),
            first(x["AABB"], "AABB of a Leaf")["min"].alias("min"), first(x["AABB"], "AABB of a Leaf")["max"].alias("max"),
            F.when(x["Points"].isNotNull(), records(x["Points"])).alias("points"),
        ),
    )
    given = F.coalesce(required(tree("AABBTree"), "AABBTree", "struct<AABBSubTree:array<struct<_level:int,_VALUE:string>>>")["AABBSubTree"], F.array().cast("array<struct<_level:int,_VALUE:string>>"))
    last = F.filter(given, lambda s, i: ~F.exists(F.slice(given, i + 2, F.size(given)), lambda o: o["_level"] == s["_level"]))
    subtrees = F.map_from_entries(F.transform(last, lambda s: F.struct(s["_level"].alias("level"), boxes(s["_VALUE"]).alias("boxes"))))
    out = docs.select(
        *rest, _aligned(tree("_aligned"), "KdTree").alias("aligned"), first(tree("Root.AABB"), "Root/AABB").alias("_root"), _matrix(tree("A_IK"), "A_IK").alias("matrix"),
        F.coalesce(leaves, F.array().cast("array<struct<level:int,idx:int,min:array<double>,max:array<double>,points:array<array<double>>>>")).alias("leaves"), subtrees.alias("subtrees"),
    )
    out = out.withColumns({"min": F.col("_root.min"), "max": F.col("_root.max"), "center": _middle(F.col("_root.min"), F.col("_root.max")), "rotation": V.quaternion_of(F.col("matrix"))})
    return out.select(*rest, "aligned", "min", "max", "center", "matrix", "rotation", "leaves", "subtrees")


def leaves_by_level(trees: DataFrame, *keys: str) -> DataFrame:
    """keys, level, and the leaves of that level in the order of the document; of ``tree_topology`` rows."""
    one = trees.select(*keys, F.posexplode("leaves").alias("at", "leaf"))
    return one.groupBy(*keys, F.col("leaf.level").alias("level")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
