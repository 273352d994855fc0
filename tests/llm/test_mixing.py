"""Mixing: targets against plain water filling, the flight's invariants, and results that neither order nor partitions change."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing

from .conftest import SCHEMA, make, words


def plain_targets(size_of, weights=(5, 2, 1), most=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(size_of.values()))
    while True:
        rate = left / max(sum(weight[s] for s in free), 1)
        above = {s for s in free if most * size_of[s] < rate * weight[s]}
        if not above:
            return out | {s: rate * weight[s] for s in free}
        out |= {s: float(most * size_of[s]) for s in above}
        free, left = free - above, left - sum(most * size_of[s] for s in above)


def check(rows, docs, near=None):
    """Targets, bounds and totals of a mix of docs (doc_id, text, source)."""
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in docs]
    assert Counter((r.doc_id, r["size"], r.source) for r in rows) == Counter(sized)
    total = defaultdict(int)
    for _, n, s in sized:
        total[s] += n
    want, taken = plain_targets(total), defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        share = want[r.source] / total[r.source] if total[r.source] else 0
        assert not r["size"] or int(share - 1e-9) <= r.copies <= int(share + 1e-9) + 1
        taken[r.source] += r.taken
    for s in total:
        largest = max(n for _, n, o in sized if o == s)
        assert abs(taken[s] - want[s]) <= max(near * want[s] if near else 0, largest if not near else 0, 1)


def result(docs):
    return sorted(map(repr, mixing.mix(docs).collect()))


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.unionByName(make(spark, [(None, words(3, 30), None)] * 7 + [(4, words(9, 30), "")] * 5 + [(1, None, "empty"), (2, "", "empty")]))
    check(mixing.mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(make(spark, [(None, None, None), (None, " ", None)])) == result(make(spark, [(None, " ", None), (None, None, None)]))


def test_many_rounds_and_reruns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(3, 1, 1500), 2000).astype(int) + 1
    rows = [(i, words(i, int(n)), "hot" if i % 3 else f"s{i % 5}") for i, n in enumerate(lengths)] + [(7, words(1, 40), "hot")] * 300
    docs = make(spark, rows)
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    first = mixing.mix(docs.repartition(5)).collect()
    check(first, rows, near=0.002)
    assert sorted(map(repr, first)) == result(make(spark, rows[::-1]).repartition(2))
    twice = [r.copies for r in first if r.doc_id == 7 and r["size"] == 40 and r.source == "hot"]
    assert len(twice) >= 300 and max(twice) - min(twice) <= 1


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 500, 30).tolist() + [7] * 6
    start = rng.random(36).round(3).tolist()
    seen = np.zeros(36)
    for turn in range(3000):
        p = list(start)
        rest = mixing.flight(size, p, random.Random(turn))
        assert len(rest) <= 2 and all(v in (0.0, 1.0) for i, v in enumerate(p) if i not in rest)
        assert sum(p) == pytest.approx(sum(start)) and np.dot(size, p) == pytest.approx(np.dot(size, start))
        seen += p
    assert np.abs(seen / 3000 - start).max() < 0.045


def test_landing_takes_the_nearest():
    rng = np.random.default_rng(6)
    size, p = rng.integers(1, 300, 9).tolist(), rng.random(9).tolist()
    want = min(abs(sum(s * (((w >> i) & 1) - v) for i, (s, v) in enumerate(zip(size, p)))) for w in range(512))
    end = list(p)
    mixing.landing(size, end, list(range(9)), 1e-9)
    assert abs(np.dot(size, end) - np.dot(size, p)) == pytest.approx(want, abs=1e-6)


def test_targets(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 60):
        size_of = {(None if i == 3 else f"é{i}" if i % 2 else f"z{i}"): int(rng.integers(0, 10) ** 6) for i in range(n)}
        rows = spark.createDataFrame([(s is None, s or "", v) for s, v in size_of.items()], "no_source boolean, name string, source_size long").repartition(3)
        got = {None if r.no_source else r.name: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(plain_targets(size_of))
