"""kd-trees built by levels and in tasks, packed, read back and descended, against a plain recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kdtree, selection


def plain(xyz, levels):
    """Leaf index of each point."""
    leaf = np.zeros(len(xyz), np.int64)
    for level in range(levels):
        new = leaf * 2
        for k in np.unique(leaf):
            own = leaf == k
            new[own] += xyz[own, level % 3] >= np.quantile(xyz[own, level % 3], 0.5)
        leaf = new
    return leaf


@pytest.mark.parametrize("few, stretch, levels", [(1 << 16, 12, 5), (300, 2, 5), (10, 3, 4)])
def test_tree(spark, tmp_path, monkeypatch, few, stretch, levels):
    monkeypatch.setattr(kdtree, "FEW", few)
    monkeypatch.setattr(kdtree, "STRETCH", stretch)
    monkeypatch.setattr(selection, "FEW", 50)
    rng = np.random.default_rng(3)
    xyz = np.column_stack([rng.normal(size=2000), rng.integers(0, 5, 2000), np.exp(rng.normal(0, 5, 2000))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double").repartition(4)
    nodes = kdtree.build(points, levels)
    nodes.write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    rows = {r.node: r for r in nodes.collect()}
    assert sorted(rows) == list(range(1, 1 << (levels + 1)))
    assert all(sum(rows[2 * k + s].points for s in (0, 1)) == rows[k].points for k in range(1, 1 << levels))
    assert all(rows[2 * k].max[r.axis] == r.cut == rows[2 * k + 1].min[r.axis] for k, r in rows.items() if r.cut is not None)
    kdtree.pack(nodes).write.parquet(str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert packed.agg(F.max(F.size("cuts"))).first()[0] == (1 << min(stretch, levels)) - 1
    again = {r.node: (r.level, r.axis, r.cut) for r in kdtree.unpack(packed).collect()}
    assert again == {k: (r.level, r.axis, r.cut) for k, r in rows.items() if r.cut is not None}
    found = kdtree.descend(points, packed, levels)
    leaf = {r.id: r.leaf for r in found.collect()}
    assert [leaf[i] for i in range(2000)] == plain(xyz, levels).tolist()
    for r in found.groupBy("leaf").count().collect():
        assert rows[r.leaf + (1 << levels)].points == r["count"]


def test_plan_does_not_grow_with_the_levels(spark):
    points = spark.range(500).selectExpr("id", "cast(id % 37 as double) x", "cast(id * 7 % 41 as double) y", "cast(id * 13 % 43 as double) z")
    size = lambda levels: len(kdtree.descend(points, kdtree.pack(kdtree.build(points, levels)), levels).select("leaf")._jdf.queryExecution().optimizedPlan().toString())
    assert size(12) < 1.1 * size(3)


def test_empty(spark):
    assert kdtree.build(spark.createDataFrame([], "x double, y double, z double"), 3).count() == 0
