"""Series over ranges: the last known value against a plain walk, one hot key among few, and arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import series


def rows_of(hot):
    rng = np.random.default_rng(4)
    n = 3000
    keys = np.where(rng.random(n) < hot, 1, rng.integers(2, 9, n))
    return [(None if k == 8 else int(k), float(t), None if rng.random() < 0.6 else float(i)) for i, (k, t) in enumerate(zip(keys, rng.permutation(n) / 2))]


@pytest.mark.parametrize("hot", [0.0, 0.97, 1.0])
@pytest.mark.parametrize("strictly", [False, True])
def test_last_known(spark, hot, strictly):
    rows = rows_of(hot)
    data = spark.createDataFrame(rows, "k long, t double, v double").repartition(3)
    value = {"s": F.when(F.col("v").isNotNull(), F.struct("t", "v"))}
    found = {(r.k, r.t): r.s for r in series.last_known(data, ["k"], "t", [], value, strictly=strictly).collect()}
    ahead = {(r.k, r.t): r.s for r in series.last_known(data, ["k"], "t", [], value, ahead=True, strictly=strictly).collect()}
    assert len(found) == len(ahead) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted((t, v) for x, t, v in rows if x == k)
        for walk, got in ((own, found), (own[::-1], ahead)):
            last = None
            for t, v in walk:
                if strictly:
                    assert got[k, t] == last
                if v is not None:
                    last = (t, v)
                if not strictly:
                    assert got[k, t] == last


def test_a_hot_key_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    data = spark.range(40_000).selectExpr("1L as k", "cast(id * 7919 % 40009 as double) as t", "cast(id as double) as v")
    rows = series.last_known(data, ["k"], "t", [], {"s": F.col("v")}, strictly=True)
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    ordered = rows.orderBy("t").collect()
    assert [r.s for r in ordered] == [None, *(r.v for r in ordered[:-1])]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 20_000 and sum(sizes) == 40_000


def test_resample_and_as_of_over_ranges(spark):
    rng = np.random.default_rng(6)
    samples = [(1 if i % 10 else 2, float(t), float(rng.normal())) for i, t in enumerate(np.sort(rng.choice(5000, 800, replace=False)) / 10)]
    data = spark.createDataFrame(samples, "k long, t double, v double")
    for linear in (True, False):
        for r in series.resample(data, "k", "t", "v", 0.0, 500.0, 7.5, linear).collect():
            own = [(t, v) for k, t, v in samples if k == r.k]
            low, high = [x for x in own if x[0] <= r.t], [x for x in own if x[0] >= r.t]
            if not low or (linear and not high):
                assert r.v is None
            elif not linear or low[-1][0] == r.t:
                assert r.v == low[-1][1]
            else:
                (t0, v0), (t1, v1) = low[-1], high[0]
                assert r.v == pytest.approx(v0 + (r.t - t0) / (t1 - t0) * (v1 - v0))
    asked = [(1, float(t)) for t in range(0, 500, 3)] + [(3, 1.0)]
    found = series.as_of(spark.createDataFrame(asked, "k long, t double"), data.withColumnRenamed("v", "w"), "k", "t", "w").collect()
    for r in found:
        own = [v for k, t, v in samples if k == r.k and t <= r.t]
        assert r.w == (own[-1] if own else None)


def test_arrays_and_changes(spark):
    row = spark.createDataFrame([([1, 1, None, None, 2, 2, 1, 1],)], "a array<int>").select(
        series.without_repeats(F.col("a")).alias("u"), series.moved_back(F.col("a"), lambda x: x == 1).alias("m"), series.without_repeats(F.slice("a", 1, 0)).alias("e")
    ).first()
    assert row.u == [1, None, 2, 1] and row.m == [None, None, 2, 2, 1, 1, 1, 1] and row.e == []
    data = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, t int, v string")
    assert [r.new for r in series.changes(data, ["k"], "t", "v").orderBy("t").collect()] == [True, False, True, False, True, True]
