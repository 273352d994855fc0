"""Graphs, pairs, cells, series, sources, sinks, the solver and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import grid, pairs, series, solver
from tessera.plans import space_queries
from tessera.plans.graph import Graph, GraphError, parse
from tessera.sources import sinks, states, tables
from tessera.streaming import live


def bodies(spark, n=300):
    return spark.range(n).selectExpr("id", "cast(id * 7 % 23 as double) x", "cast(id * 5 % 19 as double) y", "cast(id % 11 as double) z", "0.4D + (id % 5) * 0.3D as r")


def test_graph_is_strict(spark):
    g = Graph({"v": "vector", "k": "long"}).add("n", "norm").add("out", "line")
    g.link("source", "v", "n", "value").link("source", "v", "n", "value")
    with pytest.raises(GraphError, match="takes vector"):
        Graph({"k": "long"}).add("n", "norm").link("source", "k", "n", "value")
    with pytest.raises(GraphError, match="linked already"):
        g.add("t", "transform").link("t", "result", "n", "value")
    with pytest.raises(GraphError, match="no output node"):
        Graph({"v": "vector"}).add("n", "norm").link("source", "v", "n", "value").run(spark.sql("select array(1D) v"))
    with pytest.raises(GraphError, match="cycle"):
        Graph({}).add("a", "transform").add("b", "transform").link("a", "result", "b", "value").link("b", "result", "a", "value").order()
    with pytest.raises(GraphError, match="must be"):
        g.link("n", "result", "out", "value").run(spark.sql("select array(1) v, 1L k"))


def test_graph_from_xml(spark):
    g = parse(
        '<graph><source name="v" type="vector"/><node name="t" kind="transform"><value socket="translation">1 0 0</value></node><node name="n" kind="norm"/><node name="out" kind="line"/>'
        '<link from="source" output="v" to="t" input="value"/><link from="t" output="result" to="n" input="value"/><link from="n" output="result" to="out" input="value"/></graph>'
    )
    assert g.run(spark.sql("select array(2D, 4D, 0D) v")).first()["out"] == 5
    with pytest.raises(GraphError, match="needs kind"):
        parse('<graph><node name="t"/></graph>')


def test_cells_find_what_brute_force_finds(spark):
    b = bodies(spark)
    brute = {(r.id1, r.id2): r.overlap for r in pairs.overlaps_brute(b).collect()}
    assert brute and {(r.id1, r.id2): r.overlap for r in pairs.overlaps(b).collect()} == brute
    assert pairs.max_overlap(pairs.overlaps(b.limit(0))).first()[0] == 0
    sizes = b.unionByName(spark.createDataFrame([(900, 10.0, 9.0, 5.0, 30.0), (901, 3.0, 3.0, 3.0, 6.0), (902, 3.0, 3.0, 3.0, 0.0)], "id long, x double, y double, z double, r double"))
    brute = {(r.id1, r.id2): r.overlap for r in pairs.overlaps_brute(sizes).collect()}
    assert {(r.id1, r.id2): r.overlap for r in pairs.overlaps(sizes).collect()} == pytest.approx(brute) and len(brute) > 300
    assert pairs.overlaps(sizes).count() == len(brute)
    with pytest.raises(Exception, match="two bodies"):
        one = F.lit(1).cast("long")
        spark.range(1).select(pairs.contact_tag(one, one, one, one, one, one)).collect()


def test_first_parameters_win(spark):
    p = spark.createDataFrame([("a", "b", 0.1, 1), ("a", "b", 0.2, 0)], "mat_lo string, mat_hi string, mu double, n int")
    assert pairs.first_wins(p, "n").first()["mu"] == 0.2


def test_kd_tree_and_boxes(spark):
    b = bodies(spark)
    leaves = grid.kd_tree(b, 3)
    counts = [r["count"] for r in grid.assign_leaf(b, leaves).groupBy("leaf").count().collect()]
    assert sum(counts) == 300 and len(counts) == 8 and max(counts) < 80
    assert grid.kd_tree(b.limit(0), 2) == []
    turned = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (-1.0, 1.0, 0.0), (0.0, 2.0, 3.0)], "x double, y double, z double")
    box = grid.minimum_box(turned, [(1.0, 0, 0), (0, 1.0, 0), (1.0, 1.0, 0), (-1.0, 1.0, 0)]).first()
    assert box["volume"] == pytest.approx(6)
    parts = grid.split_weights(grid.cells_overlapped(b, (0.0,) * 3, (5.0,) * 3, (5, 4, 3)))
    assert parts.groupBy("id").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").isEmpty()


def test_nearest_distance_is_exact_for_all(spark):
    rows = [(i, float(i % 7), float(i * 3 % 5), 0.0) for i in range(20)] + [(100, 500.0, 0.0, 0.0), (101, 0.25, 0.0, 0.0), (102, 500.0, 0.0, 300.0)]
    found = {r.id: r.distance for r in grid.nearest_distance(spark.createDataFrame(rows, "id long, x double, y double, z double")).collect()}
    assert found == pytest.approx({i: min(math.dist(p, q) for j, *q in rows if j != i) for i, *p in rows})
    assert grid.nearest_distance(spark.createDataFrame(rows[:1], "id long, x double, y double, z double")).count() == 0


def test_series(spark):
    s = spark.createDataFrame([(1, float(t)) for t in (0, 3, 4, 9, 10, 14, 20)], "k long, t double")
    kept = lambda times, fps: [(r.t, r.frame) for r in series.frame_sampler(spark.createDataFrame([(1, float(t)) for t in times], "k long, t double"), "k", "t", fps).orderBy("frame").collect()]
    assert kept([0, 3, 4, 9, 10, 14, 20], 0.2) == [(0, 1), (9, 2), (14, 3), (20, 4)]
    assert kept([0, 0, 3, 3, 9, 9, 9, 10], 0.2) == [(0, 1), (0, 2), (9, 3), (9, 4), (9, 5)]  # repeated times of a kept frame are kept
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        times, fps = np.sort(rng.integers(0, 60, 40) / 8), float(rng.choice([0.3, 1, 2.5]))
        last, want = None, []
        for t in times:
            keep = last is None or (t - last) * fps >= 1 or t == last
            last = t if keep else last
            want.append(keep)
        for cut in (0, 7, 40):
            first, last = series.kept_frames(times[:cut], None, fps)
            assert [*first, *series.kept_frames(times[cut:], last, fps)[0]] == want
    v = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 100.0)], "k long, t double, v double")
    assert [r.v for r in series.resample(v, "k", "t", "v", -5.0, 15.0, 5.0).orderBy("t").collect()] == [None, 0, 50, 100, None]
    assert series.recorded(s, "nothing", "k").count() == 0
    with pytest.raises(ValueError):
        series.every(s, "k", 0)


def test_state_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", n, n / 10, b, [0.0] * 7, [1.0] * 6) for n in range(3) for b in range(2)], states.schema())
    path = str(tmp_path / "store")
    states.write(rows, path)
    assert states.append(rows.withColumn("sim_id", F.lit("b")), path) and states.read(spark, path).count() == 12
    assert not states.append(rows, path, nq=5)
    with pytest.raises(Exception, match="another layout"):
        states.read(spark, path, nq=6).collect()
    assert states.catalog(spark, path).count() >= 2
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/x.sim").write_bytes(states.to_binary([(0.5, [(7, [1.0] * 7, [2.0] * 6)]), (1.0, [(7, [1.5] * 7, [2.0] * 6)])]))
    read = states.read_binary(spark, str(tmp_path / "bin")).orderBy("state_nr").collect()
    assert [(r.t, r.body_id, r.q[0]) for r in read] == [(0.5, 7, 1.0), (1.0, 7, 1.5)]
    (tmp_path / "bin/y.sim").write_bytes((tmp_path / "bin/x.sim").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends inside a state"):
        states.read_binary(spark, str(tmp_path / "bin")).collect()


def test_side_files(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# m\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nf 1/1/1 2/1/1 3/1/1 4/1/1\nf 1 2 3\n")
    m = tables.mesh(spark, str(tmp_path / "m.obj"))
    assert m["vertices"].count() == 2 and m["faces"].first()["corners"] == [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]]
    doc = "<P><Description><a>1</a></Description><DataTable><Header><Column>n procs [1]</Column><Column>t</Column></Header><Data># c\n1\t2.5\n2\t3\n</Data></DataTable></P>"
    found = tables.performance_xml(spark.createDataFrame([(doc,)], "xml string")).first()
    assert found["names"] == ["n procs", "t"] and found["data"] == [[1, 2.5], [2, 3]] and found["description"] == {"a": "1"}
    assert tables.job("[Cluster]\njobName = a\nnProcesses = 4\n").processes == 4
    (tmp_path / "o").write_text("--fourth 4 --fifth 5\n")
    assert tables.options(["--first", "1", f"@{tmp_path}/o", "--sixth", "6"]) == {"first": "1", "fourth": "4", "fifth": "5", "sixth": "6"}


def test_sinks(spark, tmp_path):
    sinks.lines(spark.range(3), "id", str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["0", "1", "2"]
    sinks.xml(spark.range(3), str(tmp_path / "x"), "Root", "Child")
    assert tables.scene(spark, str(tmp_path / "x"), "Child", "id long").count() == 3


def test_solver(spark):
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0)], "id long, mass double")
    c = spark.createDataFrame([("a", 1, 2, 0.3), ("b", 2, 3, -0.1)], "contact_id string, id1 long, id2 long, gap double")
    found, turns = solver.solve_normal(c, b, solver.Settings(most_iterations=40, absolute=1e-4))
    p = {r.contact_id: r.percussion for r in found.collect()}
    assert p["b"] == 0 and p["a"] == pytest.approx(0.3 / 1.5, abs=1e-3) and turns <= 40
    colours = {r.id: r.colour for r in solver.colours(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")).collect()}
    assert all(colours[a] != colours[b] for a, b in ((1, 2), (2, 3), (1, 3), (3, 4)))


def test_jor_percussions_reach_the_fixed_point(spark, tmp_path):
    sizes = {100 + 47730 * i: s for i, s in enumerate((20, 35, 15, 30))}  # a row of bodies, 1 apart in y
    spark.createDataFrame([(k, s, "m") for k, s in sizes.items()], "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    found = {r.contact_id: r.percussion for r in space_queries.jor_percussions(spark, str(tmp_path)).collect()}
    ids = sorted(sizes)
    place = {k: (k % 37, k * 7 % 41, k * 13 % 43) for k in ids}
    gaps = {(a, b): 0.4 + (sizes[a] + sizes[b]) / 50 - math.dist(place[a], place[b]) for a in ids for b in ids if a < b}
    p = {c: 0.0 for c, gap in gaps.items() if gap > 0}
    for _ in range(5000):  # one contact after the other
        for c in p:
            push = sum(q * sum(1 / sizes[i] for i in set(c) & set(o)) for o, q in p.items() if o != c)
            p[c] = max(0.0, (gaps[c] - push) / (1 / sizes[c[0]] + 1 / sizes[c[1]]))
    assert len(p) >= 3 and found == pytest.approx({f"{a}-{b}": q for (a, b), q in p.items()}, abs=1e-5)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "s")
    frames = spark.createDataFrame([(1, float(t)) for t in (0, 3, 4, 9, 10, 14, 20)], "k long, t double")
    frames.coalesce(1).write.parquet(path)
    q = live.sampled(live.playback(spark, path, frames.schema), "k", "t", 0.2).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.t for r in spark.sql("select t from kept order by t").collect()] == [0, 9, 14, 20]


def test_entry_imports_and_keys():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(sorted(e.queries()))
