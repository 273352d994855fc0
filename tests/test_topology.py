"""Topology documents, written by hand in the layout that is read."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.sources import topology

HEAD = '<?xml version="1.0"?>\n<Topology type="{kind}" buildMode="{mode}" time="1.5">\n<Description><Run>7</Run><Host>a b</Host></Description>\n'
GRID = (
    HEAD.format(kind="Grid", mode="predefined")
    + """<AABBList>
# rank, minimum, maximum
0 0 0 0 1 2 3
5 1 2 3 2 4 6   # the last
</AABBList>
<Grid aligned="True">
  <Dimension>2 2 1</Dimension>
  <MinPoint> 0 0 0 </MinPoint>
  <MaxPoint>2 4 6</MaxPoint>
  <A_IK>
1 0 0
0 1 0
0 0 1
  </A_IK>
</Grid>
<Points>
1 2 3
4 5 x
</Points>
<NearestDistanceHistogram mean="2" stdDeviation="0.5">
1 2
3 4
</NearestDistanceHistogram>
</Topology>"""
)
TREE = (
    HEAD.format(kind="KdTree", mode="auto")
    + """<KdTree aligned="true">
<Root><AABB>0 0 0 4 4 4</AABB></Root>
<A_IK>0 -1 0\n1 0 0\n0 0 1</A_IK>
<Leafs>
  <Leaf level="2" idx="3"><AABB>0 0 0 1 4 4</AABB></Leaf>
  <Leaf level="1" idx="2"><AABB>2 0 0 4 4 4</AABB><Points>3 3 3\n2 1 0</Points></Leaf>
  <Leaf level="2" idx="4"><AABB>1 0 0 2 4 4</AABB></Leaf>
</Leafs>
<AABBTree>
  <AABBSubTree level="0">0 0 0 4 4 4</AABBSubTree>
  <AABBSubTree level="1">
0 0 0 2 4 4
2 0 0 4 4 4
  </AABBSubTree>
  <AABBSubTree level="2">9 9 9 9 9 9</AABBSubTree>
  <AABBSubTree level="2">0 0 0 1 4 4\n1 0 0 2 4 4</AABBSubTree>
</AABBTree>
</KdTree>
</Topology>"""
)


def docs(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, xml string")


def test_common_part(spark):
    row = topology.topology(docs(spark, GRID, TREE)).orderBy("file").first()
    assert (row.file, row.kind, row.build_mode, row.time, row.description) == ("f0", "Grid", "predefined", 1.5, {"Run": "7", "Host": "a b"})
    assert [(b.rank, b.min, b.max) for b in row.boxes] == [(0, [0, 0, 0], [1, 2, 3]), (5, [1, 2, 3], [2, 4, 6])]
    assert row.points[0] == [1, 2, 3] and row.points[1][:2] == [4, 5] and math.isnan(row.points[1][2])
    assert (row.distances, row["mean"], row.std_deviation) == ([1, 2, 3, 4], 2, 0.5)
    other = topology.topology(docs(spark, TREE)).first()
    assert other.kind == "KdTree" and other.boxes == other.points == other.distances == [] and other["mean"] is None


def test_grid(spark):
    g = topology.grid_topology(docs(spark, GRID)).first()
    assert (g.aligned, g.dimension, g.min, g.max, g.center, g.rotation) == (True, [2, 2, 1], [0, 0, 0], [2, 4, 6], [1, 2, 3], [0, 0, 0, 1])
    for text, want in (("true", True), ("True", True), ("false", False), ("1", False)):
        assert topology.grid_topology(docs(spark, GRID.replace('aligned="True"', f'aligned="{text}"'))).first().aligned is want


def test_tree(spark):
    trees = topology.tree_topology(docs(spark, TREE))
    t = trees.first()
    assert (t.aligned, t.min, t.max, t.center) == (True, [0, 0, 0], [4, 4, 4], [2, 2, 2])
    assert [round(x, 9) for x in t.rotation] == [0, 0, round(math.sqrt(0.5), 9), round(math.sqrt(0.5), 9)]
    assert [(x.level, x.idx, x.max, x.points) for x in t.leaves] == [(2, 3, [1, 4, 4], None), (1, 2, [4, 4, 4], [[3, 3, 3], [2, 1, 0]]), (2, 4, [2, 4, 4], None)]
    assert {k: [b.max for b in v] for k, v in t.subtrees.items()} == {0: [[4, 4, 4]], 1: [[2, 4, 4], [4, 4, 4]], 2: [[1, 4, 4], [2, 4, 4]]}
    levels = topology.leaves_by_level(trees, "file").orderBy("level").collect()
    assert [(r.file, r.level, [x.idx for x in r.leaves]) for r in levels] == [("f0", 1, [2]), ("f0", 2, [3, 4])]


@pytest.mark.parametrize(
    "read, text, message",
    [
        (topology.topology, GRID.replace('type="Grid"', 'type="Ring"'), "unknown topology Ring"),
        (topology.topology, GRID.replace(' time="1.5"', ""), "no attribute time"),
        (topology.topology, GRID.replace("Description", "Remark"), "no Description"),
        (topology.topology, GRID.replace("0 0 0 0 1 2 3", "0 0 0 0 1 2"), "another number of columns"),
        (topology.topology, GRID[:-8], "MALFORMED|Malformed"),
        (topology.grid_topology, TREE, "document has no"),
        (topology.grid_topology, GRID.replace("MinPoint", "Corner"), "no MinPoint"),
        (topology.grid_topology, GRID.replace("0 1 0\n0 0 1", "0 1 0"), "hasn't nine numbers"),
        (topology.tree_topology, TREE.replace("<Root><AABB>0 0 0 4 4 4</AABB></Root>", "<Root><AABB/></Root>"), "no Root/AABB"),
        (topology.tree_topology, TREE.replace("<AABB>0 0 0 1 4 4</AABB>", "<AABB></AABB>"), "no AABB of a Leaf"),
        (topology.tree_topology, TREE.replace("AABBTree", "Other"), "no AABBTree"),
    ],
)
def test_what_is_missing_or_wrong(spark, read, text, message):
    with pytest.raises(Exception, match=message):
        read(docs(spark, text)).collect()


def test_unused_parts_are_pruned(spark):
    """A broken box list is not noticed by who reads the time only."""
    assert topology.topology(docs(spark, GRID.replace("0 0 0 0 1 2 3", "0 0"))).select("time").first().time == 1.5


def test_records(spark):
    rows = spark.createDataFrame([("1 2\n\n 3 4 # x\n#y",), (None,), ("1  2",), ("",)], "t string").select(topology.records(F.col("t")).alias("r")).collect()
    assert rows[0].r == [[1, 2], [3, 4]] and rows[1].r == rows[3].r == [] and math.isnan(rows[2].r[0][1])
