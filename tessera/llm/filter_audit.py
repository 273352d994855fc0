"""Audit of how document filters interact, over all orders in which they can be applied.

Each text is scanned once where Arrow holds it (see ``bytescan``): byte classes and prefix sums give words, capitals,
code points and symbols, sorted and verified word hashes the distinct words. A document leaves the scan as a mask of the
filters that it fails. Only masks are counted, by part; all orders and steps follow from the 32 counts of a part.

Filters: A, few words; B, few distinct words among them; C, many capitals; D, any symbol of ``#$%&*|``; E, a text that
is identical to that of a smaller id anywhere in the table (by SHA-256).

Defined cases: a null text is empty; a null part and the empty string are one part; rows that repeat an id are documents
of their own, none of which is smaller than the other; a row without an id is no copy of anything, nor anything of it;
labels that repeat an id mark it where any of them does, null labels mark nothing; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose orders are written together.
PARTS = 64


@dataclass(frozen=True)
class Limits:
    """Least words; least distinct words and most capitals, in percent of the words and of the code points."""

    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part, words, distinct_words, capitals, symbols, code_points, digest (SHA-256 of the text's bytes)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = bytescan.texts(batch.column(2))
        words, capitals, symbols, points = bytescan.count(data, at, bytescan.CAPITAL, bytescan.SYMBOL, bytescan.HEAD)
        distinct = [bytescan.distinct_words(data, at[low : high + 1]) for low, high in bytescan.slices(at)]
        digests = [hashlib.sha256(data[low:high]).digest() for low, high in zip(at[:-1].tolist(), at[1:].tolist())]
        columns = [batch.column(0), batch.column(1), words, np.concatenate([*distinct, np.zeros(0, np.int64)]), capitals, symbols, points, pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield of(batch)

    names = ["doc_id", "part", "words", "distinct_words", "capitals", "symbols", "code_points", "digest"]
    counts = ", ".join(f"{n} long" for n in names[2:7])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, part string, {counts}, digest binary")


def failures(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part and ``mask``, with bit i set where the filter ``FILTERS[i]`` fails."""
    own = [
        F.col("words") < limits.words,
        100 * F.col("distinct_words") < limits.distinct_percent * F.col("words"),
        100 * F.col("capitals") > limits.capital_percent * F.col("code_points"),
        F.col("symbols") > 0,
    ]
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own)), F.lit(0))
    rows = materialise(measure(docs, id_col, text_col, part_col).select("doc_id", "part", mask.alias("own"), "digest"), "masks")
    # Written, so that the join has an exchange on either side and a hot text's partition can be split.
    first = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("own") + copy).cast("int").alias("mask"))


def _steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and per result the weight that each mask has in it: a matrix of steps by masks."""
    masks = np.arange(1 << len(FILTERS))
    steps, rows = [], {name: [] for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    alone = [len(ORDERS) // max(int(m).bit_count(), 1) for m in masks]  # a document's orders are shared evenly by the filters that it fails
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, earlier = (masks & bit) != 0, (masks & before) != 0
            steps.append((order, step))
            rows["kept"].append((masks & (before | bit)) == 0)
            rows["removed"].append(fails & ~earlier)
            rows["redundant"].append(fails & earlier)
            rows["unique_fails"].append(masks == bit)
            rows["shapley"].append(fails * np.array(alone))
            before |= bit
    return steps, {name: np.array(m, np.int64) for name, m in rows.items()}


def _expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, weights = _steps()
    orders, numbers = [s[0] for s in steps], [s[1] for s in steps]
    for whole in parts:
        for low in range(0, whole.num_rows, PARTS):
            batch = whole.slice(low, PARTS)
            counts = {name: np.zeros((batch.num_rows, 1 << len(FILTERS)), np.int64) for name in ("n", "good", "toxic")}
            for i, found in enumerate(batch.column(1).to_pylist()):
                for c in found:
                    for name, own in counts.items():
                        own[i, c["mask"]] = c[name]
            results = {name: (counts["n"] @ w.T).ravel() for name, w in weights.items()}
            lost = {f"{name}_lost": (counts[name] @ weights["removed"].T).ravel() for name in ("good", "toxic")}
            n = batch.num_rows
            columns = {
                "part": pa.array(np.repeat(np.array(batch.column(0).to_pylist(), object), len(steps)), pa.string()),
                "filter_order": pa.array(orders * n, pa.string()), "step": pa.array(numbers * n, pa.int32()),
                **{k: pa.array(v, pa.int64()) for k, v in (results | lost).items()},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order and step: what the step's filter does there, in documents.

    part, filter_order, step; kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    marks = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks).where("good + toxic > 0")
    counted = (
        failures(docs, limits, id_col, text_col, part_col).join(marked, "doc_id", "left")
        .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 a part at most
    results = ("kept", "removed", "redundant", "unique_fails", "shapley", "good_lost", "toxic_lost")
    return parts.mapInArrow(_expand, "part string, filter_order string, step int, " + ", ".join(f"{r} long" for r in results))
