"""Ranked search against a plain scan written from the definition."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical_search

from .conftest import SCHEMA, make, words

ITEMS = "item_id long, text string, doc_id string, score int"


def plain_terms(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))


def plain_ranks(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) of docs (doc_id, text) and items (item_id, text)."""
    found = [(d, plain_terms(t)) for d, t in docs]
    found = [(d, Counter(t), len(t)) for d, t in found if t]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c, length in found:
            m = 100 - 75 + 75 * length * n // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def found(docs, items, k=10):
    rows = lexical_search.rank_documents(docs, items, k)
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "int", "bigint", "bigint"]
    return sorted(repr(tuple(r)) for r in rows.collect())


def asked(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], ITEMS)


def corpus():
    base = [(i, words(i % 37, 5 + i * 13 % 90), "s") for i in range(150)]
    return [*base, *[(200 + i, words(3, 60), "s") for i in range(40)], (7, words(3, 60), "s"), (None, words(3, 60), "s"), (None, words(4, 9), "s"), (900, words(5, 30_000), "s"), (901, None, "s"), (902, " .,", "s"), (903, "É日本 w5 W5_w5-É", None)]


QUESTIONS = [(1, words(3, 12)), (2, words(11, 30)), (2, words(12, 3)), (None, words(4, 9).upper()), (5, ""), (6, None), (7, "w5 w5 É 日本 zzz"), (8, "never seen"), (9, words(5, 30_000))]


@pytest.mark.parametrize("small", [False, True])
def test_ranks(spark, odd_docs, monkeypatch, small):
    if small:
        for name, value in {"SHARD_DOCS": 20, "WALKED": 40, "QUERIES": 3, "MOST_TERMS": 50, "ROWS": 7, "WORDS": 4}.items():
            monkeypatch.setattr(lexical_search, name, value)
    docs = odd_docs.unionByName(make(spark, corpus())).repartition(5)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, asked(spark, QUESTIONS)) == plain_ranks(plain, QUESTIONS, 10)
    assert found(docs, asked(spark, QUESTIONS[:3]), k=3) == plain_ranks(plain, QUESTIONS[:3], 3)


def test_empty(spark):
    docs, none = spark.createDataFrame([], SCHEMA), asked(spark, [])
    assert found(docs, asked(spark, QUESTIONS)) == found(make(spark, ["a b"]), none) == found(docs, none) == found(make(spark, ["", None]), asked(spark, QUESTIONS)) == []


def test_treaps():
    rng = np.random.default_rng(2)
    term, doc = np.divmod(rng.choice(20 * 300, 2500, replace=False), 300)
    impact = rng.integers(1, 6, len(doc))
    t = lexical_search.Treaps(term, doc, impact, 20)
    for x in range(20):
        todo, seen = [(int(t.roots[x]), -1, 300, 10)], []
        while todo:
            i, low, high, most = todo.pop()
            if i < 0:
                continue
            assert low < t.doc[i] < high and t.impact[i] <= most
            seen.append(i)
            todo += [(int(t.left[i]), low, int(t.doc[i]), t.impact[i]), (int(t.right[i]), int(t.doc[i]), high, t.impact[i])]
        assert sorted(seen) == list(range(t.starts[x], t.starts[x + 1]))
    # Splits of splits agree with the greatest impact of each range.
    roots, low, high = t.roots, np.full(20, -1), np.full(20, 300)
    for at in (150, 60, 80, 90):
        hit, before, behind = t.split(roots, np.full(20, at), low, high)
        for x in range(20):
            own = slice(t.starts[x], t.starts[x + 1])
            d, w = t.doc[own], t.impact[own]
            assert (hit[x] >= 0) == (at in d) and (hit[x] < 0 or t.doc[hit[x]] == at)
            for side, inside in ((before, (d > low[x]) & (d < at)), (behind, (d > at) & (d < high[x]))):
                assert (side[x] < 0) == (not inside.any()) and (side[x] < 0 or t.impact[side[x]] == w[inside].max())
        roots, low, high = (before, low, np.full(20, at)) if at == 150 else (behind, np.full(20, at), high)
        assert (roots >= 0).all()


def test_ranges_are_pruned():
    rng = np.random.default_rng(3)
    doc = np.concatenate([np.sort(rng.choice(20_000, 4000, replace=False)) for _ in range(8)])
    term = np.repeat(np.arange(8), 4000)
    impact = rng.integers(1, 1000, len(doc)) ** 3
    t = lexical_search.Treaps(term, doc, impact, 8)
    query, score, at, scored = lexical_search.walk(t, np.zeros(8, np.int64), np.arange(8), np.arange(1, 9) ** 2, np.zeros(1, np.int64), 10)
    whole = np.bincount(doc, weights=impact * (term + 1) ** 2, minlength=20_000)
    want = np.lexsort((np.arange(20_000), -whole))[:10]
    assert at.tolist() == want.tolist() and score.tolist() == whole[want].astype(int).tolist()
    assert scored < 2000  # of 15,000 documents that hold a term
