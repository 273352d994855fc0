"""Graphs in stages: what may be linked, states without bodies, scripts, and typed sockets."""

import pytest

from tessera.plans.graph import GraphError
from tessera.plans.stages import StagedGraph, script


def graph():
    g = StagedGraph("state", {"x": "double", "pos": "vector"}, {"t": "double"})
    g.add("twice", "sum_plus_one", stage="frame_init").link("state", "t", "twice", "a")
    g.add("moved", "sum_plus_one").link("source", "x", "moved", "a").link("twice", "x", "moved", "b")
    g.add("most", "reduce.greatest", stage="frame_final").link("moved", "x", "most", "value")
    g.add("n", "reduce.count", stage="frame_final").link("source", "x", "n", "value")
    g.add("middle", "reduce.mean_vector", stage="frame_final").link("source", "pos", "middle", "value")
    g.add("out.n", "line", stage="frame_final").add("count", "number", stage="frame_final").link("n", "result", "count", "value").link("count", "result", "out.n", "value")
    return g


def test_frames(spark):
    states = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "state long, t double")
    bodies = spark.createDataFrame([(1, 7, 1.0, [1.0, 0.0, 0.0]), (1, 8, 5.0, [3.0, 2.0, 0.0]), (2, 7, 2.0, [0.0] * 3), (9, 7, 2.0, [0.0] * 3)], "state long, id long, x double, pos array<double>")
    g = graph()
    for name, stage, at in (("a", "frame_init", "twice"), ("b", "body", "moved")):
        g.add(name, "line", stage=stage).link(at, "x", name, "value")
    g.add("c", "line", stage="frame_final").link("most", "result", "c", "value").add("d", "line.vector", stage="frame_final").link("middle", "result", "d", "value")
    f = g.run_frames(states, bodies, ["id"])
    assert sorted(map(tuple, f.frame_init.collect())) == [(1, 11.0), (2, 21.0), (3, 31.0)]
    assert sorted(map(tuple, f.body.collect())) == [(1, 7, 13.0), (1, 8, 17.0), (2, 7, 24.0)]
    assert sorted((r.state, r["out.n"], r.c, r.d) for r in f.frame_final.collect()) == [(1, 2.0, 17.0, [2.0, 1.0, 0.0]), (2, 1.0, 24.0, [0.0] * 3), (3, 0.0, None, None)]
    f.frame_final = f.frame_final.drop("d")
    lines = [tuple(r) for r in script(g, f, "id").where("state = 1").orderBy("stage", "id", "line").collect()]
    assert lines == [(1, 0, None, "11.0"), (1, 1, 7, "13.0"), (1, 1, 8, "17.0"), (1, 2, None, "17.0"), (1, 2, None, "2.0")]


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda g: g.link("moved", "x", "twice", "b"), "twice runs before moved"),
        (lambda g: g.add("y", "sum_plus_one", stage="frame_final").link("moved", "x", "y", "a"), "needs a reducing kind"),
        (lambda g: g.add("y", "reduce.sum", stage="frame_final").link("twice", "x", "y", "value"), "reduces bodies"),
        (lambda g: g.add("y", "reduce.sum"), "in frame_final only"),
        (lambda g: g.add("y", "norm", stage="later"), "no stage later"),
        (lambda g: g.link("state", "speed", "moved", "b"), "no output speed"),
        (lambda g: g.add("z", "sum_plus_one").link("most", "result", "z", "a"), "z runs before most"),
    ],
)
def test_what_may_not_be(change, message):
    with pytest.raises(GraphError, match=message):
        change(graph())


def test_no_output_and_wrong_types(spark):
    g = StagedGraph("state", {"x": "double"}, {"t": "double"}).add("n", "reduce.count", stage="frame_final")
    rows = spark.createDataFrame([(1, 1.0)], "state long, t double")
    with pytest.raises(GraphError, match="no output node"):
        g.run_frames(rows, rows.withColumnRenamed("t", "x"))
    with pytest.raises(GraphError, match="source x must be double"):
        graph().run_frames(rows, rows)


def test_sockets():
    g = graph()
    assert g.socket("twice", "a") == ("input", "double") and g.socket("twice", "x") == ("output", "double") and g.socket("twice", "z") is g.socket("none", "a") is None
    assert g.value("twice", "b", "double") == 0.0 and g.set("twice", "b", "double", 2.5).value("twice", "b", "double") == 2.5
    for ask, message in ((("twice", "b", "long"), "is double, not long"), (("twice", "a", "double"), "from a link"), (("twice", "z", "double"), "is nothing")):
        with pytest.raises(GraphError, match=message):
            g.value(*ask)
