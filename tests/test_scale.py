"""What plans and tasks hold must not grow with whole tables: each test failed before the step was dealt out."""

import contextlib
import io
import math
import re

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow.fs  # noqa: F401 - before memory is traced
from pyspark.sql import functions as F

from tessera.operators import blocks, pairs, solver
from tessera.functions import scalars as S
from tessera.plans import extension_queries, space_queries
from tessera.sources import binary


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def some_bodies(spark, n=300):
    k = F.col("id")
    return spark.range(n).select("id", (k % 7).cast("double").alias("x"), (k * 3 % 5).cast("double").alias("y"), (k * 5 % 11).cast("double").alias("z"), (F.lit(0.05) + k % 13 / 10).alias("r"))


def test_pairs_are_not_broadcast(spark):
    """Plans take the copies of the bodies for small."""
    b = some_bodies(spark)
    contacts = pairs.overlaps(b)
    frames = pairs.contact_frames(contacts.select("id1", "id2"), b)
    assert "Broadcast" not in plan(contacts) and "Broadcast" not in plan(frames)
    want = {(r.id1, r.id2): r.overlap for r in pairs.overlaps_brute(b).collect()}
    found = [((r.id1, r.id2), r.overlap) for r in contacts.collect()]
    assert dict(found) == want and len(found) == len(want) and len(want) > 1000
    assert frames.count() == len(want)


def test_a_state_is_not_held(tmp_path):
    """Two states of two hundred thousand bodies, in pieces: a task holds little of what it writes."""
    n, pieces = 1000, 200
    out = binary._Output(str(tmp_path), False)
    files = binary._StateFiles(SimpleNamespace(out=out, nq=7, nu=6))
    v = np.ones((n, 13))
    tracemalloc.start()
    for number in (3, 4):
        for k in range(pieces):
            files.add("s", number, np.full(n, number / 2), np.arange(k * n, (k + 1) * n), v)
    names = files.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * pieces * 14 * 8 / 2
    out.commit(names)
    (path, size), = binary._files(str(tmp_path))
    with open(path, "rb") as f:
        head = binary._head(f, path, size)
    assert (head.bodies, head.states, head.first, head.last, head.sim_id) == (n * pieces, 2, 3, 4, "s")


def test_hot_bucket_is_dealt_out(spark):
    """All points in one bucket: the pairs come from several tasks, each once."""
    points = spark.range(400).withColumn("x", F.col("id") % 10 + 0.5)
    spans = spark.range(60).select(F.col("id").alias("span"), (F.col("id") % 6).cast("double").alias("low"), (F.col("id") % 6 + 3).cast("double").alias("high"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = extension_queries.interval_join(points, spans, "x", "low", "high", 100.0)
        rows = [(r.id, r.span) for r in found.collect()]
        tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(rows) == sorted((i, s) for i in range(400) for s in range(60) if s % 6 <= i % 10 + 0.5 < s % 6 + 3)
    assert tasks > 1


def test_sketches_stand_apart(spark, tmp_path):
    """No sketch is kept for each supplier."""
    k = F.col("id")
    spark.range(2000).select((k % 3).cast("string").alias("l_returnflag"), (k % 500).alias("l_suppkey"), (k * 7 % 1000).cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = extension_queries.x_percentiles(spark, str(tmp_path))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*l_suppkey[^\]]*\].*approx", text)
    assert {r.l_returnflag: r.suppliers for r in out.collect()} == {"0": 500, "1": 500, "2": 500}


def test_percussions_of_bodies_with_many_contacts(spark):
    """Single steps go to and fro for ever; blocks settle."""
    chance = np.random.default_rng(3)
    n, places = 60, chance.uniform(0, 3, size=(60, 3))
    places[1] = places[0]
    gaps = {(a, b): float(2.0 - np.linalg.norm(places[a] - places[b])) for a in range(n) for b in range(a) if np.linalg.norm(places[a] - places[b]) < 2.0}
    masses = chance.uniform(1, 30, n)
    contacts = spark.createDataFrame([(f"{a}-{b}", a, b, g) for (a, b), g in gaps.items()], "contact_id string, id1 long, id2 long, gap double")
    bodies = spark.createDataFrame([(i, float(masses[i]), *map(float, places[i])) for i in range(n)], "id long, mass double, x double, y double, z double")
    found, rounds = solver.solve_normal(contacts, bodies, solver.Settings(most_iterations=6))
    p = {r.contact_id: r.percussion for r in found.collect()}
    assert rounds < 6 and len(p) == len(gaps) and min(p.values()) >= 0
    v = np.zeros(n)
    for a, b in gaps:
        v[[a, b]] += p[f"{a}-{b}"] / masses[[a, b]]
    late = {(a, b): v[a] + v[b] - g for (a, b), g in gaps.items()}
    assert min(late.values()) > -1e-5 and max(abs(p[f"{a}-{b}"] * x) for (a, b), x in late.items()) < 1e-4


def test_blocks_are_bounded():
    """Even where all bodies are in one place."""
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 8000)
    for places in (np.zeros((8000, 3)), np.random.default_rng(2).normal(size=(8000, 3))):
        cuts = blocks.Cuts(places[:2000], 4, 7)
        sizes = np.bincount(cuts.of(*map(pd.Series, places.T), pd.Series(hashes)))
        assert (sizes > 0).sum() == 16 and sizes.max() < 3 * 8000 / 16


def test_all_pairs_by_chunks(spark):
    """No join of all bodies with all others, and the same contacts for any number of chunks."""
    b = some_bodies(spark)
    rows = [tuple(r) for r in b.collect()]
    want = {(i, j): (r + s) - math.sqrt((u - x) ** 2 + (v - y) ** 2 + (w - z) ** 2) for i, x, y, z, r in rows for j, u, v, w, s in rows if i < j and (u - x) ** 2 + (v - y) ** 2 + (w - z) ** 2 < (r + s) ** 2}
    for chunk in (16, 1024):
        out = pairs.overlaps_brute(b, chunk)
        found = [((r.id1, r.id2), r.overlap) for r in out.collect()]
        assert len(found) == len(want) and dict(found) == want
        if chunk < len(rows):
            assert not any("id_a" in x for x in plan(out).splitlines() if "NestedLoop" in x or "Cartesian" in x)


def exchanged(df) -> int:
    """Rows that go through the largest exchange of the plan."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_cells_are_not_exchanged(spark):
    """Bodies go to the blocks that they touch, not to each cell; and no contact is dealt out for its frame."""
    b = some_bodies(spark).cache()
    contacts = pairs.overlaps(b, ("x", "y", "z", "r"))
    assert 0 < exchanged(contacts) < 12 * b.count()
    frames = {(r.id1, r.id2): r for r in pairs.contact_frames(pairs.overlaps(b).select("id1", "id2"), b).collect()}
    for r in pairs.contact_frames(contacts).collect():
        other = frames[r.id1, r.id2]
        assert (r.e_x, r.e_y, r.e_z, r.p) == (other.e_x, other.e_y, other.e_z, other.p)
        assert r.e_z is None or abs(np.linalg.det([r.e_z, r.e_x, r.e_y]) - 1) < 1e-9


def test_rounding_agrees(spark):
    chance = np.random.default_rng(5)
    values = [*chance.normal(size=500), *(chance.integers(-99, 99, 200) / 10**6 + 0.5e-6), *(10.0 ** chance.integers(-9, 17, 50)), 0.0, -0.0, 2.5e-6, -2.5e-6, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert rows.where(~F.round("v", 6).eqNullSafe(S.rounded(F.col("v")))).count() == 0


def test_contacts_are_not_exchanged(spark, tmp_path):
    """Percussions of the step before and shapes come along with bodies: neither pairs nor contacts are dealt out or stored."""
    spark.range(3000).select((F.col("id") * 65231 + F.col("id") % 50).alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("m").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    for query in (space_queries.percussion_join, space_queries.oriented_pairs):
        out = query(spark, str(tmp_path))
        assert "Join" not in plan(out) and "ExistingRDD" not in plan(out)
        assert exchanged(out) < 12 * 3000 < out.count()


def test_colours_without_contacts(spark):
    """No two bodies that touch share a colour, few colours are used, and no contact is stored; giants and bodies in one place too."""
    b = some_bodies(spark).unionByName(spark.createDataFrame([(900, 3.0, 2.0, 5.0, 4.0), (901, -3.0, 0.0, -1.0, 3.5), (902, 3.0, 2.0, 5.0, 4.0)], "id long, x double, y double, z double, r double"))
    out = solver.coloured(b)
    found = {r.id: r.colour for r in out.collect()}
    contacts = [(r.id1, r.id2) for r in pairs.overlaps_brute(b).collect()]
    degree = np.bincount(np.array(contacts).ravel())
    assert out.count() == len(found) == 303 and min(found.values()) >= 0
    assert all(found[i] != found[j] for i, j in contacts) and len(set(found.values())) <= degree.max() + 1
    assert solver.coloured(b.limit(0)).count() == 0
