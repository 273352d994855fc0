"""Exact quantiles against NumPy, over several passes, with ties, nulls and groups of all sizes."""

import numpy as np
import pytest

from tessera.operators import selection

FRACTIONS = [0.0, 0.1, 0.5, 0.999, 1.0]


@pytest.mark.parametrize("few", [1 << 16, 40])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=30_001), "wide": np.exp(rng.normal(0, 60, 20_000)) * rng.choice([-1, 1], 20_000), "ties": rng.integers(0, 4, 25_000).astype(float),
        "half": np.concatenate([np.full(10_000, 5.0), rng.random(10_000) * 10]), "one": np.array([3.5]), "two": np.array([2.0, 1.0]), None: rng.random(500), "equal": np.full(9000, -1.25),
    }
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("even", None), ("none", None)]
    found = selection.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(6), ["g"], "x", FRACTIONS).collect()
    assert {r.g for r in found} == set(groups)
    for r in found:
        want = np.quantile(groups[r.g], FRACTIONS)
        assert np.allclose(r.quantiles, want, rtol=1e-12, atol=0), r.g


def test_without_groups_and_empty(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 10)
    rows = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) x")
    want = np.quantile([i * 7919 % 20011 for i in range(20_000)], [0.25, 0.5])
    assert selection.quantiles(rows, [], "x", [0.25, 0.5]).first().quantiles == pytest.approx(want.tolist())
    assert selection.quantiles(rows.limit(0), [], "x", [0.5]).count() == 0
