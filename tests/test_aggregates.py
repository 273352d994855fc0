"""User aggregates: the same result for any partitioning, exact sums, nulls and many groups."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import aggregates
from tessera.operators.aggregates import Use, aggregate


class Span(aggregates.Aggregate):
    """Least and greatest product of two columns, as an array."""

    result = "array<double>"

    def zero(self):
        return math.inf, -math.inf

    def update(self, state, a, b):
        return self.merge(state, (float((a * b).min()), float((a * b).max())))

    def merge(self, a, b):
        return min(a[0], b[0]), max(a[1], b[1])

    def finish(self, state):
        return None if state[0] > state[1] else list(state)


@pytest.mark.parametrize("most", [100_000, 3])
def test_any_partitioning(spark, monkeypatch, most):
    monkeypatch.setattr(aggregates, "MOST_GROUPS", most)
    monkeypatch.setitem(aggregates.AGGREGATES, "span", Span())
    rng = np.random.default_rng(1)
    rows = [(None if i % 50 == 0 else f"g{i % 7 if i % 3 else 0}", i % 2, float(rng.normal() * 10.0 ** rng.integers(-200, 200)) if i % 11 else None, int(rng.integers(0, 3000))) for i in range(5000)]
    rows += [("none", 0, None, None), ("odd", 0, math.inf, 1), ("odd", 0, 1.0, 1), ("nan", 0, math.inf, 1), ("nan", 0, -math.inf, 1)]
    data = spark.createDataFrame(rows, "g string, h int, x double, y long")
    uses = {"total": Use("exact_sum", ("x",)), "many": Use("distinct_sketch", ("y",)), "span": Use("span", ("y", "h"))}
    found = []
    for parts in (1, 5, 40):
        out = aggregate(data.repartition(parts), ["g", "h"], uses).collect()
        found.append({(r.g, r.h): (repr(r.total), r.many, r.span) for r in out})
    assert found[0] == found[1] == found[2]
    groups = defaultdict(list)
    for g, h, x, y in rows:
        groups[g, h].append((x, y))
    assert set(found[0]) == set(groups)
    for key, own in groups.items():
        total, many, span = found[0][key]
        xs, ys = [x for x, _ in own if x is not None], [y for _, y in own if y is not None]
        if key[0] in ("odd", "nan"):
            assert total == {"odd": "inf", "nan": "nan"}[key[0]]
        else:
            assert total == repr(math.fsum(xs))
        distinct = sorted(set(ys))
        assert many == (len(distinct) if len(distinct) < 256 else 255 / (distinct[255] / (1 << 60)))
        assert span == ([min(y * key[1] for y in ys), max(y * key[1] for y in ys)] if ys else None)


def test_without_keys_and_empty(spark):
    data = spark.range(1000).selectExpr("cast(id as double) / 10 x")
    assert [tuple(r) for r in aggregate(data, [], {"s": Use("exact_sum", ("x",))}).collect()] == [(math.fsum(i / 10 for i in range(1000)),)]
    assert aggregate(data.limit(0), [], {"s": Use("exact_sum", ("x",))}).count() == 0
    with pytest.raises(ValueError, match="no aggregate"):
        aggregate(data, [], {"s": Use("median", ("x",))})


def test_the_sketch_is_near():
    sketch = aggregates.DistinctSketch()
    rng = np.random.default_rng(2)
    state = sketch.zero()
    for _ in range(20):
        state = sketch.merge(state, sketch.update(sketch.zero(), rng.choice(rng.integers(0, 1 << 60, 5000), 9000)))
    assert abs(sketch.finish(state) / 85_000 - 1) < 0.25
