"""Formulas against Python's own arithmetic, and errors with their places; extractors in one scan."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import formulas
from tessera.operators import extract, kdtree

GOOD = [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("2 ^ -1", 0.5), ("10 - 4 - 3", 3), ("8 / 4 / 2", 1), ("1 / 0", None), ("1.5e2 + .5", 150.5), ("- - x", 3), ("+x", 3),
    ("x * y - z", 7), ("min(x, y, z)", 3), ("max(x)", 3), ("sqrt(abs(-16))", 4), ("atan2(1, 1)", math.pi / 4), ("if(x < y and not (y < x or x == z), pi, e)", math.pi), ("if(x >= 3 or 1 / 0 > 1, 1, 2)", 1), ("floor(-1.5)", -2), ("x<y", True),
]
BAD = [("1 +", 3, "ends too early"), ("(1", 2, r"\) expected"), ("1 2", 2, "not expected"), ("a + 1", 0, "unknown name a"), ("x & y", 2, "unknown character"), ("sqrt(1, 2)", 0, "takes 1 arguments"), ("x < y < z", 6, "not expected"), ("1 + (x < y)", 4, "a number expected"), ("not x", 4, "a truth value"), ("x and y", 0, "a truth value"), ("", 0, "ends too early"), ("if(x, 1, 2)", 3, "a truth value")]


def test_formulas(spark):
    rows = spark.createDataFrame([(3.0, 4.0, 5.0)], "x double, y double, z double")
    got = rows.select(*(formulas.compiled(t, {c: F.col(c) for c in "xyz"}).alias(str(i)) for i, (t, _) in enumerate(GOOD))).first()
    assert list(got) == [pytest.approx(v) if v is not None else None for _, v in GOOD]


@pytest.mark.parametrize("text, at, what", BAD)
def test_errors_say_where(spark, text, at, what):
    with pytest.raises(formulas.FormulaError, match=what) as e:
        formulas.compiled(text, {c: F.col(c) for c in "xyz"})
    assert e.value.at == at


def test_extractors_scan_once(spark, tmp_path):
    spark.range(400).selectExpr("cast(id % 20 as double) x", "cast(id % 7 as double) y", "cast(id % 3 as double) z", "cast(id as double) m").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    kdtree.pack(kdtree.build(points, 2)).write.parquet(str(tmp_path / "t"))
    tree = spark.read.parquet(str(tmp_path / "t"))
    found = extract.extract(
        points,
        [extract.Grid("a", (0.0, 0, 0), (5.0, 5, 5), (4, 2, 1), {"m": ("sum", "m")}), extract.Grid("b", (10.0, 0, 0), (1.0, 1, 1), (2, 2, 2), {"low": ("least", "y")}), extract.Tree("t", tree, {"m": ("sum", "m")})],
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Scan parquet") == 2  # the points and the tree
    rows = {(r.extractor, r.cell): r for r in found.collect()}
    assert sum(r["count"] for (e, _), r in rows.items() if e == "a") == sum(r["count"] for (e, _), r in rows.items() if e == "t") == 400
    assert sum(r.m for (e, _), r in rows.items() if e == "t") == 399 * 200 and all(r.m is None for (e, _), r in rows.items() if e == "b")
    inside = points.where("x >= 10 and x < 12 and y < 2 and z < 2").count()
    assert sum(r["count"] for (e, _), r in rows.items() if e == "b") == inside
    with pytest.raises(ValueError, match="another meaning"):
        extract.extract(points, [extract.Grid("a", (0.0,) * 3, (1.0,) * 3, (1,) * 3, {"m": ("sum", "m")}), extract.Grid("b", (0.0,) * 3, (1.0,) * 3, (1,) * 3, {"m": ("mean", "m")})])
