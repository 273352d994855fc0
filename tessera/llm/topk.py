"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Vectors are dealt into shards of bounded size. In a shard, each dimension's vectors are kept by quantised value; such a
posting segment has one impact for a query, the largest product that any of its vectors can reach there. Segments are
processed by descending impact into accumulators, which with the impact of the next segment bound every score from
above. Processing stops only when these bounds leave few vectors that could reach the best k known so far; those are
rescored exactly. Ties go to the smaller id.

All queries run past the first shard; the k-th score that a query reaches there is a proven floor, which goes with it to
the other shards. A task indexes one shard once and streams a block of queries past it: queries are copied once a shard,
vectors once a block, and a block is as long as a task can work off, as it isn't held.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no part, nor does one without
an id; a vector whose square could pass 2**53 fails the job, as bounds would no longer be exact (with 64 components:
one beyond 46,000 at the default scale); missing trailing components count as 0; fewer than k candidates give fewer rows; rows that repeat an id are one
candidate, with the best of their scores, and one query, which takes the best of its rows' scores and skips all rows
with its id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Rows of a shard; they bound a task's memory. Queries of a block, at the first shard and at the others; they bound its time.
SHARD_ROWS, FIRST_QUERIES, QUERIES = 8192, 1024, 65_536
#: Bound on the square of a vector, up to which doubles hold all sums of products exactly.
EXACT = float(1 << 53)
#: Values per quantised level, rounds in which segments are processed, and possible members that are few enough to rescore.
LEVEL, ROUNDS, FEW = 4, 8, 256


class Index:
    """Posting segments of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.repeats = len(np.unique(ids)) < len(ids)
        n, dims = vectors.shape
        levels = vectors // LEVEL
        order = np.argsort(levels, axis=0, kind="stable")
        self.postings = order.T.ravel().astype(np.int32)
        by_dim = np.take_along_axis(levels, order, axis=0).T
        new = np.ones((dims, n), bool)
        new[:, 1:] = by_dim[:, 1:] != by_dim[:, :-1]
        self.starts = np.flatnonzero(new.ravel())
        self.lengths = np.diff(np.append(self.starts, n * dims))
        self.dims = self.starts // n
        values = np.take_along_axis(vectors, order, axis=0).T.ravel()
        self.low, self.high = np.minimum.reduceat(values, self.starts), np.maximum.reduceat(values, self.starts)

    def top(self, query: np.ndarray, skip: int, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all rows that can be among the k best; ``known``: a score that k rows elsewhere reach."""
        n, dims = self.vectors.shape
        q = query[self.dims]
        impact = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-impact, kind="stable")
        lengths, starts, impact = self.lengths[order], self.starts[order], impact[order]
        ends = np.cumsum(lengths)
        bound, unseen = np.zeros(n), np.full(n, dims, np.int32)
        allowed = self.ids != skip
        scored = np.zeros(0, np.int64)
        members, done = np.flatnonzero(allowed), 0
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(1, ROUNDS) * (n * dims // ROUNDS)), len(order)))
        for cut in cuts:
            if cut <= done:
                continue
            at = lengths[done:cut]
            first = np.repeat(starts[done:cut] - np.append(0, np.cumsum(at)[:-1]), at)
            rows = self.postings[first + np.arange(len(first))]
            bound += np.bincount(rows, weights=np.repeat(impact[done:cut], at), minlength=n)
            unseen -= np.bincount(rows, minlength=n).astype(np.int32)
            done = cut
            rest = float(impact[done]) if done < len(order) else 0.0
            upper = np.where(allowed, bound + unseen * rest, -np.inf)
            # The best by their bounds are rescored: k exact scores are a proven floor.
            best = np.argpartition(-upper, min(4 * k, n - 1))[: 4 * k]
            scored = np.union1d(scored, best[allowed[best]])
            _, exact = self._distinct(scored, self.vectors[scored] @ query)
            exact = np.sort(exact)[::-1]
            floor = max([x for x in (known, int(exact[k - 1]) if len(exact) >= k else None) if x is not None], default=None)
            members = np.flatnonzero(upper >= floor) if floor is not None else np.flatnonzero(allowed)
            if len(members) <= FEW:
                break
        return self._distinct(members, self.vectors[members] @ query)

    def _distinct(self, at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows ``at``, each once, with the best of its scores."""
        ids = self.ids[at]
        if self.repeats and len(ids):
            order = np.lexsort((-scores, ids))
            ids, scores = ids[order], scores[order]
            first = np.append(True, ids[1:] != ids[:-1])
            ids, scores = ids[first], scores[first]
        return ids, scores


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of a matrix of at least ``width`` columns, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(int(lengths.max(initial=0)), width)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _search(k: int):
    """A map over rows (pair, known, asks, id, v), a shard's vectors before a block of queries: query_id, vec_id, score."""

    def of_shard(index: Index, queries: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        vectors = _matrix(queries.column(4), index.vectors.shape[1])
        for q_id, known, q in zip(queries.column(3).to_pylist(), queries.column(1).to_pylist(), vectors):
            found, scores = index.top(q[: index.vectors.shape[1]], q_id, k, known)
            best = np.lexsort((found, -scores))[:k]
            best = best[scores[best] >= known] if known is not None else best
            out += zip([q_id] * len(best), found[best].tolist(), scores[best].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, pair = None, None
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (asks[1:] != asks[:-1]))[: len(at)]).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(at)]):
                part = batch.slice(low, high - low)
                if at[low] != pair:
                    index, pair, held = None, at[low], []
                if not asks[low]:
                    held.append(part)
                    continue
                if index is None and held:
                    width = max(int(np.diff(p.column(4).offsets.to_numpy()).max()) for p in held)
                    index = Index(np.concatenate([p.column(3).to_numpy() for p in held]), np.vstack([_matrix(p.column(4), width) for p in held]))
                    held = []
                if index is not None:
                    yield of_shard(index, part)

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for every row for which ``is_query`` holds."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) * scale + 1
    levels = F.when(F.size(v) * largest * largest < EXACT, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
    levels = F.coalesce(levels, F.raise_error(F.lit("a vector is too long for exact scores")).cast("array<bigint>"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), levels.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # Dealt evenly by row number: neither repeated ids nor repeated vectors can fill one shard.
    dealt = rows.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))
    queries = rows.where("asks").groupBy("id", "v").agg(F.min("row").alias("row"))
    n_queries = rows.where("asks").count()

    def search(own: DataFrame, asking: DataFrame, low: int, high: int, size: int) -> DataFrame:
        blocks = max(1, -(-n_queries // size))
        pair = lambda shard, block: F.col(shard) * F.lit(blocks) + F.col(block)
        own = own.where(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asking = asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        together = own.select(pair("shard", "block").alias("pair"), F.lit(None).cast("long").alias("known"), F.lit(False).alias("asks"), "id", "v").unionByName(
            asking.select(pair("shard", "block").alias("pair"), "known", F.lit(True).alias("asks"), "id", "v")
        )
        return together.repartitionByRange((high - low) * blocks, "pair").sortWithinPartitions("pair", "asks").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    found = materialise(search(dealt, queries.withColumn("known", F.lit(None).cast("long")), 0, 1, FIRST_QUERIES), "found")
    if shards > 1:
        best = found.groupBy("query_id").agg(F.array_sort(F.collect_list(-F.col("score"))).alias("s"))  # k scores a row of the query
        floors = best.select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, -F.element_at("s", k)).alias("known"))
        # Rows that repeat an id may name one vector twice among their scores: they go without a floor.
        floors = queries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").join(floors, "id").select("id", "known")
        found = found.unionByName(search(dealt, queries.join(floors, "id", "left"), 1, shards, QUERIES))
    scores = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
