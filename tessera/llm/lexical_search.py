"""Ranked lexical search over inverted treaps (after Konow, Navarro, Clarke and López-Ortiz, 2013).

Documents are dealt into shards of bounded size. In a shard each term has a treap of its postings: search order by
document, heap order by impact, so that a treap's root bounds all below it. All treaps of a query are walked together
over ranges of documents: the roots' weighted impacts sum up to a bound on every score in the range, and a range whose
bound can't enter the k best is left with all its subtrees. Otherwise the document of the weightiest root is scored
exactly and parts the range, and each treap splits at it on the way down. Ranges of many queries are walked side by
side, as arrays.

One shard goes first; the k-th score that a query reaches there is a proven floor, with which it goes to the others.

Only terms that occur in some query are indexed: a bitmap of fixed size, over hashes of the queries' terms, keeps the
others out (a false hit costs a posting, nothing else). Counts and lengths are those of all terms of all documents.

Defined cases: a null text has no terms, a document or query without terms has no rows; scores are above 0; ties go to
the smaller id, null ids last; rows that repeat a document's id are documents of their own, rows that repeat a query's
id are queries of their own with ranks of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan
from .common import materialise

#: Bounds of a shard: documents and postings, both on average. Queries that visit a shard together.
SHARD_DOCS, SHARD_POSTINGS, QUERIES = 8192, 1 << 20, 4096
#: Roots of treaps that are walked side by side, about.
WALKED = 1 << 18
#: Words of 64 bits in the bitmap of the queries' terms: 1 MB.
WORDS = 1 << 17
#: Terms that a task remembers or has counted before it starts afresh.
MOST_TERMS = 500_000
#: Rows of an Arrow batch.
ROWS = 1000

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts terms.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256)))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return raw.translate(_FOLD).split()


def _raw(column: pa.Array) -> Iterator[bytes]:
    data, at = bytescan.texts(column)
    return (data[low:high].tobytes() for low, high in zip(at[:-1].tolist(), at[1:].tolist()))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query (a number of the row), item_id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                found = [Counter(terms(t)) for t in _raw(part.column(2))]
                at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "term", "times"])

    numbered = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col))
    return materialise(numbered.mapInArrow(run, "query long, item_id long, term binary, times long"), "query-terms")


def _bitmap(asked: DataFrame) -> np.ndarray:
    bit = asked.select(F.pmod(F.xxhash64("term"), F.lit(WORDS * 64)).cast("int").alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).collect()  # ``WORDS`` rows at most
    out = np.zeros(WORDS, np.int64)
    for w, bits in words:
        out[w] = bits
    return out


class _Wanted:
    """Which of a document's terms the bitmap holds."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.seen, self.yes = bitmap, set(), set()

    def of(self, counts: Counter) -> list[bytes]:
        new = counts.keys() - self.seen
        if new:
            if len(self.seen) > MOST_TERMS:
                self.seen, self.yes = set(), set()
                new = counts.keys()
            for t in new:
                bit = xxhash.xxh64_intdigest(t, 42) % (WORDS * 64)  # a power of two: the sign doesn't matter
                if (int(self.bitmap[bit >> 6]) >> (bit & 63)) & 1:
                    self.yes.add(t)
            self.seen |= new
        return [t for t in counts if t in self.yes]


def postings(docs: DataFrame, bitmap: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: per document its id, length, terms (joined by a space) and their counts (32 bits each), and per
    task and term the documents that hold it; under the null term all documents and terms."""

    def rows(ids, lengths, names, counts) -> pa.RecordBatch:
        n = len(lengths)
        columns = [ids, pa.array(lengths, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, columns_of)

    def sums(held: Counter, documents: int, total: int) -> pa.RecordBatch:
        n = len(held) + 1
        columns = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        columns += [pa.array([None, *held], pa.binary()), pa.array([documents, *held.values()], pa.int64()), pa.array([total] + [None] * len(held), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, columns_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, documents, total = _Wanted(bitmap), Counter(), 0, 0
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                at, lengths, names, counts = [], [], [], []
                for i, raw in enumerate(_raw(part.column(1))):
                    found = terms(raw)
                    documents, total = documents + bool(found), total + len(found)
                    tf = Counter(found)
                    own = wanted.of(tf)
                    if own:
                        at.append(i)
                        lengths.append(len(found))
                        names.append(b" ".join(own))
                        counts.append(array("I", map(tf.__getitem__, own)).tobytes())
                        held.update(own)
                yield rows(part.column(0).take(pa.array(at, pa.int64())), lengths, names, counts)
                if len(held) > MOST_TERMS:
                    yield sums(held, 0, 0)
                    held = Counter()
        yield sums(held, documents, total)

    columns_of = ["doc_id", "length", "terms", "counts", "term", "documents", "total"]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    found = read.mapInArrow(run, "doc_id long, length long, terms binary, counts binary, term binary, documents long, total long")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "postings")


class Treaps:
    """The treaps of a shard's terms, as flat arrays over the postings in order of term and document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        # Equal impacts are ordered by chance, or many would make a chain.
        chance = np.random.default_rng(1).integers(0, 1 << 20, len(order))
        self.left, self.right, self.roots = self._links(((self.impact << 20) | chance).tolist(), self.starts.tolist())

    @staticmethod
    def _links(priority: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, roots = [-1] * len(priority), [-1] * len(priority), []
        for low, high in zip(starts, starts[1:]):
            spine: list[int] = []  # the way from the root to the last posting
            for i in range(low, high):
                p, last = priority[i], -1
                while spine and priority[spine[-1]] < p:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots.append(spine[0] if spine else -1)
        return np.array(left, np.int64), np.array(right, np.int64), np.array(roots, np.int64)

    def split(self, node: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each treap below ``node``, bounded by the documents between ``low`` and ``high``: the posting of ``at``, and the
        roots of what lies before and behind it (-1: none)."""
        hit, before, behind = (np.full(len(node), -1, np.int64) for _ in range(3))
        active, current = np.arange(len(node)), node
        while len(active):
            d, goal = self.doc[current], at[active]
            less, more = d < goal, d > goal
            new = active[less & (d > low[active])]
            new = new[before[new] < 0]
            # The first node on the way that lies on a side is the highest there.
            before[new] = current[np.searchsorted(active, new)]
            new = active[more & (d < high[active])]
            new = new[behind[new] < 0]
            behind[new] = current[np.searchsorted(active, new)]
            found = ~(less | more)
            hit[active[found]] = current[found]
            current = np.where(less, self.right[current], self.left[current])
            goes_on = ~found & (current >= 0)
            active, current = active[goes_on], current[goes_on]
        for side, first, then, outside in ((before, self.left, self.right, lambda d, i: d <= low[i]), (behind, self.right, self.left, lambda d, i: d >= high[i])):
            active = np.flatnonzero((hit >= 0) & (side < 0))
            current = first[hit[active]]
            while len(active):
                active, current = active[current >= 0], current[current >= 0]
                out = outside(self.doc[current], active)
                side[active[~out]] = current[~out]
                active, current = active[out], then[current[out]]
        return hit, before, behind


class _Best:
    """The k best of each query so far: scores and documents."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, n = k, len(floors)
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.floor, self.cut = floors.copy(), np.zeros(n, np.int64)

    def enters(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score of ``doc``, or of a later one, can be among the best: above the floor, or level with it and earlier."""
        floor = self.floor[query]
        return (score > floor) | ((score == floor) & (doc < self.cut[query]))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = self.enters(query, score, doc)
        query, score, doc = (np.concatenate([old, new[good]]) for old, new in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]
        last = np.flatnonzero(rank[keep] == self.k - 1)
        self.floor[self.query[last]], self.cut[self.query[last]] = self.score[last], self.doc[last]


def walk(treaps: Treaps, query: np.ndarray, term: np.ndarray, weight: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, score and document of the ``k`` best scores above ``floors``, and the number of documents scored for it.

    ``query`` ascends; each of its entries is a term of the query with its weight.
    """
    best, scored = _Best(floors, k), 0
    node = treaps.roots[term]
    there = node >= 0
    node, weight, query = node[there], weight[there], query[there]
    if not len(node):
        return best.query, best.score, best.doc, 0
    # Ranges: their query and the documents they lie between; treaps of one range stand together.
    asks, owner = np.unique(query, return_inverse=True)
    low, high = np.full(len(asks), -1, np.int64), np.full(len(asks), np.iinfo(np.int64).max)
    waiting: list[tuple] = [(asks, low, high, owner, node, weight)]
    while waiting:
        asks, low, high, owner, node, weight = waiting.pop()
        part = treaps.impact[node] * weight
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        alive = best.enters(asks, np.add.reduceat(part, first), low + 1)
        if not alive.any():
            continue
        stays = alive[owner]
        number = np.cumsum(alive) - 1
        owner, node, weight, part = number[owner[stays]], node[stays], weight[stays], part[stays]
        asks, low, high = asks[alive], low[alive], high[alive]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        if len(node) > WALKED and len(asks) > 1:
            # The better half by bounds is walked first, as it lifts the floors for the other.
            bound = np.add.reduceat(part, first)
            better = bound >= np.median(bound)
            better[0] &= not better.all()
            for half in (~better, better):
                at, own = half[owner], np.cumsum(half) - 1
                waiting.append((asks[half], low[half], high[half], own[owner[at]], node[at], weight[at]))
            continue
        top = np.flatnonzero(part == np.maximum.reduceat(part, first)[owner])
        at = treaps.doc[node[top[np.unique(owner[top], return_index=True)[1]]]]
        hit, before, behind = treaps.split(node, at[owner], low[owner], high[owner])
        scores = np.add.reduceat(np.where(hit >= 0, treaps.impact[hit] * weight, 0), first)
        scored += len(scores)
        best.add(asks, scores, at)
        sides = []
        for roots, near, far in ((before, low, at), (behind, at, high)):
            live = roots >= 0
            ranges, own = np.unique(owner[live], return_inverse=True)
            sides.append((asks[ranges], near[ranges], far[ranges], own, roots[live], weight[live]))
        n = len(sides[0][0])
        joined = tuple(np.concatenate([a, b + n] if i == 3 else [a, b]) for i, (a, b) in enumerate(zip(*sides)))
        if len(joined[0]):
            waiting.append(joined)
    return best.query, best.score, best.doc, scored


def _index(table: pa.Table, documents: int, total: int) -> tuple[list, dict[bytes, int], Treaps]:
    """Ids and rows in search order, numbers of the terms, and the treaps of a shard (doc_id, row, length, terms, counts)."""
    order = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls come last
    names = [t.split(b" ") for t in order.column("terms").to_pylist()]
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for own in names for t in own), np.int64)
    tf = np.frombuffer(b"".join(order.column("counts").to_pylist()), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(names)), [len(own) for own in names])
    norm = np.array([25 + 75 * n * documents // total for n in order.column("length").to_pylist()], np.int64)
    return [order.column(c).to_pylist() for c in ("doc_id", "row")], number, Treaps(term, doc, 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]), len(number))


_FOUND = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])


def _search(documents: int, total: int, k: int):
    def run(shard: pa.Table, asking: pa.Table) -> pa.Table:
        if not shard.num_rows or not asking.num_rows:
            return _FOUND.empty_table()
        (ids, rows), number, treaps = _index(shard, documents, total)
        entries = [[(number[e["term"]], e["weight"]) for e in own if e["term"] in number] for own in asking.column("terms").to_pylist()]
        sizes = np.array([sum(int(treaps.starts[t + 1] - treaps.starts[t]) for t, _ in own) for own in entries])
        floors = np.array([0 if x is None else x - 1 for x in asking.column("known").to_pylist()], np.int64)
        out = []
        # Queries are walked side by side while their postings are few enough to be held as ranges.
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (4 * WALKED), prepend=-1)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(sizes)]):
            flat = np.array([(q, t, w) for q, own in enumerate(entries[low:high]) for t, w in own], np.int64).reshape(-1, 3)
            query, score, doc, _ = walk(treaps, *flat.T, floors[low:high], k)
            out += zip((query + low).tolist(), score.tolist(), doc.tolist())
        numbers, items = asking.column("query").to_pylist(), asking.column("item_id").to_pylist()
        columns = zip(*((numbers[q], items[q], ids[d], rows[d], s) for q, s, d in out)) if out else [()] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item."""
    asked = query_terms(items, item_col, item_text_col)
    rows = postings(docs, _bitmap(asked), id_col, text_col)
    documents, total = rows.where("total is not null").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = materialise(rows.where("term is not null").groupBy("term").agg(F.sum("documents").alias("df")), "document-counts")
    weight = F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1))) * F.col("times")
    weighed = asked.join(held, "term").select("query", "item_id", "term", weight.cast("long").alias("weight")).where("weight > 0")
    asking = materialise(weighed.groupBy("query", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "queries")

    own = rows.where("terms is not null").select("doc_id", "row", "length", "terms", "counts")
    n, held_postings = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("counts")), F.lit(0))).first()
    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil(held_postings / 4 / SHARD_POSTINGS))
    blocks = max(1, math.ceil(asking.count() / QUERIES))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    blocked = asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))

    def search(asking: DataFrame, low: int, high: int) -> DataFrame:
        sent = asking.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        here = dealt.where(F.col("shard").between(low, high - 1))
        return here.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_search(documents, total, k), "query long, item_id long, doc_id long, row long, score long")

    found = materialise(search(blocked.withColumn("known", F.lit(None).cast("long")), 0, 1), "first")
    if shards > 1:
        floors = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("known")).where(F.col("n") >= k).drop("n")
        found = found.unionByName(search(blocked.join(floors, "query", "left"), 1, shards))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
