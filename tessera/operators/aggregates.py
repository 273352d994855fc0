"""Aggregates of one's own, by name: partial states in the tasks that read the rows, merged in a tree, then finished.

An aggregate says how a state takes in arrays of values, how two states merge, and what a state comes to; states travel as
bytes. Each task keeps one state a group and gives them out when it ends or holds ``MOST_GROUPS`` of them, so rows are
never shuffled. The states of a group meet in ``BRANCHES`` merges first and in one then: none sees more than a share of
the tasks' states, however hot the group is.

Results are the same for any partitioning where ``merge`` is associative and commutative, as it is for those given here.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Groups of which a task holds states, and merges among which the states of a group are shared at first.
MOST_GROUPS, BRANCHES = 100_000, 32


class Aggregate:
    """Subclass and ``register``. ``result`` is the Spark type of what ``finish`` returns; rows with a null argument are left out."""

    result = "double"

    def zero(self):
        raise NotImplementedError

    def update(self, state, *values: np.ndarray):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state):
        raise NotImplementedError

    def pack(self, state) -> bytes:
        return pickle.dumps(state)

    def unpack(self, raw: bytes):
        return pickle.loads(raw)


AGGREGATES: dict[str, Aggregate] = {}


def register(name: str, aggregate: Aggregate) -> None:
    AGGREGATES[name] = aggregate


class ExactSum(Aggregate):
    """The sum of doubles, rounded once, at the end: mantissas are summed as integers by their exponents.

    NaN, or infinities of both signs, give NaN; an infinity gives itself.
    """

    def zero(self):
        return {}, 0.0

    def update(self, state, values):
        sums, odd = state
        values = values.astype(float)
        finite = np.isfinite(values)
        odd = odd + float(values[~finite].sum()) if not finite.all() else odd
        mantissa, exponent = np.frexp(values[finite])
        whole = (mantissa * (1 << 53)).astype(np.int64)
        at, place = np.unique(exponent, return_inverse=True)
        # Two halves, so that no sum of up to 2**36 of them passes 64 bits.
        halves = []
        for part in (whole >> 26, whole & ((1 << 26) - 1)):
            total = np.zeros(len(at), np.int64)
            np.add.at(total, place, part)
            halves.append(total.tolist())
        return self.merge((sums, odd), ({int(e): (high << 26) + low for e, high, low in zip(at, *halves)}, 0.0))

    def merge(self, a, b):
        sums = dict(a[0])
        for e, n in b[0].items():
            sums[e] = sums.get(e, 0) + n
        return sums, a[1] + b[1]

    def finish(self, state):
        sums, odd = state
        if odd != 0.0:
            return odd
        exact = sum((Fraction(n) * Fraction(2) ** (e - 53) for e, n in sums.items()), Fraction(0))
        try:
            return float(exact)
        except OverflowError:
            return float("inf") if exact > 0 else float("-inf")


class DistinctSketch(Aggregate):
    """About how many hashes differ, from the ``k`` least ones: integers spread evenly from 0 to below ``top``. Exact up to ``k``."""

    def __init__(self, k: int = 256, top: int = 1 << 60):
        self.k, self.top = k, top

    def zero(self):
        return np.zeros(0, np.int64)

    def update(self, state, hashes):
        return self.merge(state, hashes.astype(np.int64))

    def merge(self, a, b):
        return np.union1d(a, b)[: self.k]

    def finish(self, state):
        return float(len(state)) if len(state) < self.k else (self.k - 1) / (float(state[-1]) / self.top)

    def pack(self, state):
        return state.tobytes()

    def unpack(self, raw):
        return np.frombuffer(raw, np.int64)


register("exact_sum", ExactSum())
register("distinct_sketch", DistinctSketch())


@dataclass(frozen=True)
class Use:
    """An aggregate by its name, over columns."""

    aggregate: str
    columns: tuple[str, ...]


def aggregate(rows: DataFrame, keys: list[str], uses: dict[str, Use]) -> DataFrame:
    """keys, and a column for each of ``uses``. Null keys are keys; a group whose rows all have a null argument gets what no row comes to."""
    unknown = [u.aggregate for u in uses.values() if u.aggregate not in AGGREGATES]
    if unknown:
        raise ValueError(f"no aggregate {unknown[0]}")
    chosen = [(AGGREGATES[u.aggregate], len(u.columns)) for u in uses.values()]
    names = [f"_v{i}" for i in range(sum(n for _, n in chosen))]
    columns = [c for u in uses.values() for c in u.columns]
    types = [dict(rows.dtypes)[k] for k in keys]

    def states(groups: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        found = [pa.array([k[i] for k in groups], t) for i, t in enumerate(kinds)]
        packed = [pa.array([chosen[j][0].pack(s[j]) for s in groups.values()], pa.binary()) for j in range(len(chosen))]
        return pa.RecordBatch.from_arrays([*found, *packed], [*key_names, *state_names])

    kinds = [to_arrow_type(T.DataType.fromDDL(a.result)) for a, _ in chosen]
    key_names, state_names = [f"_k{i}" for i in range(len(keys))], [f"_s{j}" for j in range(len(chosen))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(keys))]
            table = pa.table({"_at": pa.array(np.arange(batch.num_rows)), **{k: batch.column(i) for i, k in enumerate(key_names)}})
            grouped = table.group_by(key_names).aggregate([("_at", "list")]) if keys else pa.table({"_at_list": [list(range(batch.num_rows))] if batch.num_rows else []})
            arguments = [batch.column(len(keys) + i) for i in range(len(names))]
            present = [np.asarray(c.is_valid()) for c in arguments]
            values = [c.fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_primitive(c.type) else c.to_numpy(zero_copy_only=False) for c in arguments]
            for *key, at in zip(*(grouped.column(k).to_pylist() for k in key_names), grouped.column("_at_list")):
                own = at.values.to_numpy() if isinstance(at.values, pa.Array) else np.array(at.as_py())
                held = groups.setdefault(tuple(key), [a.zero() for a, _ in chosen])
                first = 0
                for j, (a, n) in enumerate(chosen):
                    keep = own[np.logical_and.reduce([present[i][own] for i in range(first, first + n)])]
                    if len(keep):
                        held[j] = a.update(held[j], *(values[i][keep] for i in range(first, first + n)))
                    first += n
            if len(groups) > MOST_GROUPS:
                yield states(groups, kinds)
                groups = {}
        if groups:
            yield states(groups, kinds)

    def merged(last: bool):
        def run(table: pa.Table) -> pa.Table:
            out = []
            for j, (a, _) in enumerate(chosen):
                state = a.zero()
                for raw in table.column(f"_s{j}").to_pylist():
                    state = a.merge(state, a.unpack(raw))
                out.append(pa.array([a.finish(state)], kinds[j]) if last else pa.array([a.pack(state)], pa.binary()))
            head = [table.column(k).slice(0, 1).combine_chunks() for k in key_names]
            more = [] if last else [table.column("_branch").slice(0, 1).combine_chunks()]
            return pa.Table.from_arrays([*head, *more, *out], [*key_names, *([] if last else ["_branch"]), *(uses if last else state_names)])

        return run

    head = ", ".join(f"{n} {t}" for n, t in zip(key_names, types))
    joined = lambda *parts: ", ".join(p for p in parts if p)
    packed = ", ".join(f"{s} binary" for s in state_names)
    read = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, key_names)), *(F.col(c).alias(n) for c, n in zip(columns, names)))
    first = read.mapInArrow(partial, joined(head, packed)).withColumn("_branch", F.spark_partition_id() % BRANCHES)
    some = first.groupBy(*key_names, "_branch").applyInArrow(merged(False), joined(head, "_branch int", packed))
    results = ", ".join(f"{n} {a.result}" for n, (a, _) in zip(uses, chosen))
    found = some.groupBy(*key_names).applyInArrow(merged(True), joined(head, results))
    return found.withColumnsRenamed(dict(zip(key_names, keys)))
