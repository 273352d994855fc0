"""Binary sources: round trips over many partitions, pushed filters, and files that don't fit."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import binary


def states(spark, n_states, bodies, sims=("a", "é b")):
    rows = spark.range(len(sims) * n_states * bodies).select(
        F.element_at(F.array(*map(F.lit, sims)), (F.col("id") % len(sims) + 1).cast("int")).alias("sim_id"), (F.floor(F.col("id") / len(sims)) % n_states * 3).alias("state_nr"),
        F.floor(F.col("id") / (len(sims) * n_states)).alias("body_id"),
    )
    v = lambda n, k: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.col("state_nr") * k + F.col("body_id") * 7 + i).cast("double"))
    return rows.withColumn("t", F.col("state_nr") / 2).withColumn("q", v(7, 1)).withColumn("u", v(6, -1)).select("sim_id", "state_nr", "t", "body_id", "q", "u")


def same(a, b):
    total = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()
    return total(a) == total(b)


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_states_round_trip(spark, tmp_path):
    rows = states(spark, 40, 2500)
    path = str(tmp_path / "s")
    binary.write_states(rows, path, partitions=3)
    names = os.listdir(path)
    assert len(names) >= 3 and all(n.endswith(".tss") for n in names)
    read = binary.read_states(spark, path, partitionBytes=50_000)
    assert read.rdd.getNumPartitions() > 100 and same(read, rows)
    assert same(binary.read_states(spark, "file://" + path, fromState=6, toState=30), rows.where("state_nr BETWEEN 6 AND 30"))
    binary.write_states(rows.where("state_nr < 9"), path, mode="overwrite")
    assert same(binary.read_states(spark, path), rows.where("state_nr < 9"))
    binary.write_states(rows.where("state_nr >= 9"), path)
    assert same(binary.read_states(spark, path), rows)


def test_filters_are_pushed(spark, tmp_path, pushed):
    rows = states(spark, 30, 50)
    path = str(tmp_path / "s")
    binary.write_states(rows, path)
    for condition in ("state_nr = 12", "state_nr > 12 AND state_nr <= 60", "state_nr >= 13 AND body_id < 7", "body_id IN (3, 5, 99)", "body_id = 4 AND body_id IN (3, 4)", "state_nr < 0", "state_nr = 12 OR body_id = 1", "q[0] > 50 AND state_nr < 40 AND sim_id = 'a'"):
        assert same(binary.read_states(spark, path, partitionBytes=3000).where(condition), rows.where(condition)), condition
    all_of, one = (binary.read_states(spark, path, partitionBytes=3000).where(c).rdd.getNumPartitions() for c in ("t >= 0", "state_nr = 12"))
    assert one <= all_of / 10


def test_states_that_dont_fit(spark, tmp_path):
    rows = states(spark, 2, 3, ("a",))
    for bad in (rows.where("state_nr = 0 OR body_id < 2"), rows.union(rows), rows.withColumn("q", F.slice("q", 1, 6)), rows.withColumn("t", F.lit(None).cast("double")), rows.withColumn("t", F.col("body_id") * 1.0)):
        with pytest.raises(Exception, match="layout|other bodies"):
            binary.write_states(bad, str(tmp_path / "bad"), partitions=1)
        assert not os.path.exists(tmp_path / "bad") or not os.listdir(tmp_path / "bad")
    path = tmp_path / "good"
    binary.write_states(rows, str(path), partitions=1)
    with pytest.raises(Exception, match="another layout"):
        binary.read_states(spark, str(path), nq=6).collect()
    (file,) = path.iterdir()
    whole = file.read_bytes()
    for content, message in ((whole[:-5], "cut short"), (b"no states", "no state file"), (b"", "no state file")):
        file.write_bytes(content)
        with pytest.raises(Exception, match=message):
            binary.read_states(spark, str(path)).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        binary.read_states(spark, str(tmp_path / "nowhere")).collect()
    binary.write_states(rows.limit(0), str(tmp_path / "empty"))
    assert binary.read_states(spark, str(tmp_path / "empty")).count() == 0


def test_records(spark, tmp_path):
    layout = "id:i8, x:f8[3], small:u1, f:f4"
    path = tmp_path / "r"
    path.mkdir()
    packed = struct.Struct("<q3dBf")
    (path / "one.bin").write_bytes(b"HEAD" + b"".join(packed.pack(i, i, i / 2, -i, i % 256, 0.5) for i in range(5000)))
    (path / "_hidden").write_bytes(b"x")
    read = binary.read_records(spark, str(path), layout, skip=4, partitionBytes=9000)
    assert read.rdd.getNumPartitions() == 5000 // (9000 // packed.size) + 1
    row = read.where("record = 4321").first()
    assert (row.id, row.x, row.small, row.f, os.path.basename(row.file)) == (4321, [4321, 2160.5, -4321], 4321 % 256, 0.5, "one.bin")
    binary.write_records(read, str(tmp_path / "w"), layout)
    assert same(binary.read_records(spark, str(tmp_path / "w"), layout).drop("file", "record"), read.drop("file", "record"))
    for bad in (read.withColumn("small", F.lit(300)), read.withColumn("x", F.array(F.lit(1.0))), read.withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="layout"):
            binary.write_records(bad, str(tmp_path / "b"), layout)
    with pytest.raises(Exception, match="ends inside a record"):
        binary.read_records(spark, str(path), layout).collect()
    with pytest.raises(ValueError, match="no field"):
        binary.record_type("id:i9")
    assert np.dtype(binary.record_type("a:i4,b:f8[2]")).itemsize == 20
