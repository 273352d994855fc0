"""Filter audit against brute force: every order applied to every document, one filter after the other."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bytescan, filter_audit

from .conftest import SCHEMA, make, words

LABELS = "doc_id long, quality int, toxic int, source string"


def plain_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(found), len(set(found)), len(re.findall(r"[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    parts = [" ", "\n", "\t", "\x0b", "a", "A", "é", "日本", "😀", "#", "word", "x" * 9, "y" * 300, "z" * 300 + "q", "\x00", "\x1c", "　", "abcdefgh", "abcdefg\x00", "  "]
    return ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 60))) for _ in range(n)]


def measured(texts):
    data, at = bytescan.texts(pa.array(texts, pa.string()))
    counts = bytescan.count(data, at, bytescan.CAPITAL, bytescan.SYMBOL, bytescan.HEAD)
    distinct = [bytescan.distinct_words(data, at[low : high + 1]) for low, high in bytescan.slices(at)]
    return list(zip(counts[0].tolist(), np.concatenate(distinct).tolist(), counts[1].tolist(), counts[2].tolist(), counts[3].tolist()))


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
@pytest.mark.parametrize("bits", [2, 48])
def test_scan(monkeypatch, block, bits):
    """Whatever the size of blocks, and where nearly all hashes collide."""
    monkeypatch.setattr(bytescan, "BLOCK", block)
    if bits == 2:
        monkeypatch.setattr(bytescan, "_hashes", lambda words, starts, lengths: (lengths.astype(np.uint64) % np.uint64(3)) << np.uint64(62))
    texts = [*random_texts(block, 60), None, "", " ", "a b a", words(3, min(20 * block, 2000)), " ".join(["long" * min(20 * block, 5000)] * 2)]
    assert measured(texts) == [plain_counts(t or "") for t in texts]


def test_scan_of_slices_of_arrow_columns():
    texts = ["one two", None, "B b", "x"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["front", *texts, "back"], kind).slice(1, 4)
        data, at = bytescan.texts(column)
        assert bytescan.count(data, at)[0].tolist() == [2, 0, 2, 1]


def plain_audit(docs, labels):
    """Rows (doc_id, text, source) through each order, one document at a time."""
    failed = []
    for doc_id, text, source in docs:
        text = text or ""
        w, d, c, s, n = plain_counts(text)
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 2 * n, "D": s > 0}
        fails["E"] = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs)
        marks = [any(i == doc_id and i is not None and m[k] == 1 for i, *m in labels) for k in (0, 1)]
        failed.append((source or "", fails, *marks))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in failed}:
            left = [f for f in failed if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [f for f in left if f[1][x]]
                redundant = sum(f[1][x] for f in gone)
                left, gone = [f for f in left if not f[1][x]], gone + removed
                unique = sum(f[0] == part and f[1][x] and sum(f[1].values()) == 1 for f in failed)
                out[part, order, step] = (len(left), len(removed), redundant, unique, sum(f[2] for f in removed), sum(f[3] for f in removed))
                shapley[part, x] += len(removed)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit(spark, odd_docs):
    extra = [(100 + i, t, None if i % 3 == 0 else f"src{i % 2}") for i, t in enumerate([words(7, 300), words(7, 300), words(7, 300) + " #", "A B C", "a " * 500, words(8, 250) + " |", "", None])]
    docs = odd_docs.unionByName(make(spark, [*extra, extra[0], (50, extra[1][1], ""), (None, extra[1][1], "src1")]))
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110)] + [(100, 0, 1), (100, 1, None), (None, 1, 1), (5, None, None)]
    labels = [(i, q, None if t is None else int(t), "clash") for i, q, t in labels]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = plain_audit(rows, [x[:3] for x in labels])
    assert found(docs, spark.createDataFrame(labels, LABELS)) == want
    assert found(docs.repartition(7), spark.createDataFrame([], LABELS)) == plain_audit(rows, [])


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0
