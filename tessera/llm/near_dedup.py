"""Near-duplicates by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

A document is the set of its distinct word shingles; two are linked when their sets' similarity reaches a threshold.

1. Each text is read once and becomes a sketch of minwise tokens and a digest of its set. Documents with one set are
   one class, carried on by its least id.
2. Each of ``TREES`` independent trees has minwise functions of its own. A root node holds the documents that share the
   tree's first token. Nodes of up to ``NODE`` documents are compared exhaustively by their sketches. In larger ones
   every document is compared with the node's first: what is anything like it joins its cluster, what is very like it
   goes no further, the rest branches on by the tokens at chosen positions: two on the second level, one each on the
   third. Nodes still large there hold documents that share all tokens of a path: they go on together, without any pair.
3. What was found alike so far only gathers documents into loose clusters, which may hold too much but hardly miss a
   pair. Full sets decide inside the clusters. Those of up to ``CHUNK`` documents are compared in one task, until all
   members are joined. Larger ones are dealt into chunks that share a few pivots, which joins most near copies; what is
   left outside a cluster's main component then meets the rest of the cluster through an exact prefix filter: tokens in
   one order, those that are frequent in the cluster last, with length and position bounds. Documents that merely share
   a passage so become no pairs. No pair of a cluster that reaches the threshold goes unexamined.

What is missed: a pair at similarity 0.8 shares no root node with probability 0.2**12 (4e-9). Where all its nodes are
large, it can be missed only if every tree parts it: (1 - 0.8 * 0.96 * 0.8)**12, 1.1e-5. It fails the sketch filter in a
node with probability below 1e-6. A document that stops in a large node loses nothing: whatever agrees with it in
``AGREE`` positions agrees with the node's first in ``GATHER`` and joins the same cluster.

Defined cases: a null or empty text has an empty set, links with nothing and stays; a text with fewer words than a
shingle has one shingle, all its words; rows without an id link with nothing and stay; repeated rows are one class; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

TREES, POSITIONS, LEVELS = 12, 64, 3
#: Largest node that is compared exhaustively, and largest group whose full sets meet in one task.
NODE, CHUNK = 256, 128
#: Positions of 64 that must agree: 5.4 standard deviations below the mean at similarity 0.8.
AGREE = 34
#: In a large node: positions in which a document must agree with the first to go no further, and to join its cluster.
STOP = 56
GATHER = STOP + AGREE - POSITIONS
#: Pivots that all chunks of a large cluster share; members whose tokens are counted to put them in order (any order gives
#: the same links), and tokens that are told apart as frequent.
PIVOTS, COUNTED, FREQUENT = 8, 128, 8192
MOST_WORDS = 500_000

_RNG = np.random.default_rng(20260101)
_FACTORS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Sets of hashed word shingles; the hashes of words are kept while they fit."""

    def __init__(self, words: int):
        self.words, self.known = words, _WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; words are runs without the six ASCII white space characters, A-Z lower-cased."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        span = min(self.words, len(words))
        s = np.full(len(words) - span + 1, span, np.uint64)
        for i in range(span):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
        return np.unique(s)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each of ``POSITIONS`` hash functions."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[low : low + 2048, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), set_key, keys (of the root nodes, one a tree) and sketch (a byte of each minwise token)."""
    salt = np.arange(TREES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                n, set_key, keys, sketch = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles.of(text)
                    n.append(len(s))
                    if not len(s):
                        set_key.append(None), keys.append([]), sketch.append(None)
                        continue
                    tokens = minwise(s)
                    set_key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append((tokens[: len(salt)] ^ salt).view(np.int64).tolist())
                    sketch.append((tokens >> np.uint64(40)).astype(np.uint8).tobytes())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_key", "keys", "sketch"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, set_key binary, keys array<long>, sketch binary")
    return materialise(rows, "sketches")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the component of each of ``n`` indices under the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, sketch) with a node's rows together: links (a, b) that join what is alike in each node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 50_000:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))  # where the last node begins
            yield from _compare(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield from _compare(pa.Table.from_batches(held))


def _compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
    sketch = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(key), POSITIONS)
    first, second = [], []
    for d in range(1, min(NODE, len(key))):
        at = np.flatnonzero(key[:-d] == key[d:])
        if not len(at):
            break
        for low in range(0, len(at), 100_000):
            i = at[low : low + 100_000]
            alike = i[(sketch[i] == sketch[i + d]).sum(axis=1) >= AGREE]
            first.append(alike), second.append(alike + d)
    if first:
        root = roots(len(key), np.concatenate(first), np.concatenate(second))
        own = np.flatnonzero(root != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[own]]), pa.array(ids[own])], ["a", "b"])


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that gather the ids of ``classes`` (id, keys, sketch) into loose clusters."""
    links = None
    members = classes.select(F.posexplode("keys").alias("tree", "key"), "id", "sketch")
    small_nodes = []
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(POSITIONS)), lambda i: F.substring("sketch", i, F.lit(1)) == F.substring("first.sketch", i, F.lit(1))))
    for level in range(1, LEVELS + 1):
        # Written out, so that the join has an exchange on either side and a large node can be split.
        nodes = materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "sketch")).alias("first")).where("size > 1"), "nodes")
        placed = materialise(members.join(nodes, "key"), "members")
        small_nodes.append(placed.where(F.col("size") <= NODE).select("key", "id", "sketch"))
        large = placed.where((F.col("size") > NODE) & (F.col("id") != F.col("first.id"))).withColumn("same", same)
        # At the last level all go on together.
        gathered = large.where(F.col("same") >= (GATHER if level < LEVELS else 0)).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
        links = gathered if links is None else links.unionByName(gathered)
        if level < LEVELS:
            if large.isEmpty():
                break
            # Positions that no other tree reads: TREES of them at the roots, then four a tree.
            base = F.lit(TREES + 1) + 4 * F.pmod("tree", F.lit(TREES))
            chosen = F.sequence(F.lit(0), F.lit(1)) if level == 1 else F.array(2 + F.floor(F.col("tree") / TREES))
            children = large.where(F.col("same") < STOP).withColumn("turn", F.explode(chosen))
            position = (base + F.col("turn")).cast("int")
            child = F.xxhash64("key", position, F.substring(F.col("sketch"), position, F.lit(1)))
            # Branches of the second level are told apart by ``tree``, as their children read positions of their own.
            tree = F.col("tree") + TREES * F.col("turn") if level == 1 else F.col("tree")
            members = children.select(tree.cast("int").alias("tree"), child.alias("key"), "id", "sketch")
    compared = small_nodes[0]
    for more in small_nodes[1:]:
        compared = compared.unionByName(more)
    found = compared.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_nodes, "a long, b long")
    return found.unionByName(links)


class Group:
    """Documents whose full sets meet in one task."""

    def __init__(self, sets: list[np.ndarray], threshold: tuple[int, int]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, self.codes = np.unique(flat, return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.mark = np.zeros(int(self.codes.max()) + 1, np.int32)
        self.up, self.down = threshold

    def linked(self, i: int) -> np.ndarray:
        """Which documents are linked with document ``i``, by their full sets."""
        own = self.codes[self.starts[i] : self.ends[i]]
        self.mark[own] = 1
        shared = np.add.reduceat(self.mark[self.codes], self.starts)
        self.mark[own] = 0
        return self.down * shared >= self.up * (self.sizes[i] + self.sizes - shared)

    def components(self) -> np.ndarray:
        """Least index of each document's component; ends as soon as all are joined."""
        n = len(self.sizes)
        label = np.arange(n)
        order, tried = [0], np.zeros(n, bool)
        while len(order):
            i = order.pop()
            tried[i] = True
            hit = np.unique(label[self.linked(i)])
            if len(hit) > 1:
                label[np.isin(label, hit)] = hit[0]
            # Next a document outside the largest component: what is joined needs no more comparing among itself.
            counts = np.bincount(label, minlength=n)
            outside = np.flatnonzero(~tried & (label != counts.argmax()))
            if not len(outside):
                break
            order = [int(outside[0])]
        return label


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns, which stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if held and low < batch.num_rows and new[low]:
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def _sets(t: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in t.column(column).to_pylist()]


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id of its component), kept.

    ``threshold`` (p, q): sets are linked when q * shared >= p * together.
    """
    rows = sketches(docs, words, id_col, text_col)
    sets = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    of_class = rows.where(sets).groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = materialise(of_class, "classes")
    loose = materialise(connected_components(candidate_links(classes)), "loose")
    sizes = materialise(loose.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK)).cast("int")
    placed = loose.join(sizes, "component").select("id", F.col("component").alias("cluster"), "size", chunk.alias("chunk"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [shingles.of(x).tobytes() for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], ["cluster", "chunk", "id", "size", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    joined = texts.join(placed, "id").select("cluster", "chunk", "id", "size", "text")
    full = joined.mapInArrow(to_sets, "cluster long, chunk int, id long, size long, shingles binary")
    full = materialise(full.where(F.octet_length("shingles") > 0), "sets")
    small, large = full.where(F.col("size") <= CHUNK), full.where(F.col("size") > CHUNK)

    def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            ids = t.column("id").to_numpy()
            label = Group(_sets(t, "shingles"), threshold).components()
            own = np.flatnonzero(label != np.arange(len(ids)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[own]]), pa.array(ids[own])], ["a", "b"])

    def together(groups: DataFrame) -> DataFrame:
        return groups.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "id")

    links = together(small.select("cluster", "chunk", "id", "shingles")).mapInArrow(join_groups, "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, together, join_groups, threshold))
    components = connected_components(links)
    final = materialise(
        classes.select("set_key", "id").join(components, "id", "left").select("set_key", F.coalesce("component", "id").alias("component")), "final"
    )
    out = rows.withColumn("set_key", F.when(sets, F.col("set_key"))).join(final, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _large_links(large: DataFrame, together, join_groups, threshold: tuple[int, int]) -> DataFrame:
    """Links that join the members of clusters dealt into chunks."""
    from pyspark.sql.window import Window

    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    order = Window.partitionBy("cluster").orderBy(F.xxhash64("id", F.lit(2)), "id")
    # Thinned by hash first, so that no task sorts a cluster.
    thinned = large.where(F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / (2 * COUNTED))) == 0)
    counted = materialise(thinned.withColumn("at", F.row_number().over(order)).where(F.col("at") <= COUNTED), "counted")
    everywhere = counted.where(F.col("at") <= PIVOTS).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    columns = ["cluster", "chunk", "id", "shingles"]
    dealt = large.select(columns).unionByName(everywhere.select(columns)).dropDuplicates(["cluster", "chunk", "id"])
    first = materialise(together(dealt).mapInArrow(join_groups, "a long, b long"), "links")

    # What isn't in its cluster's main component meets the rest of the cluster.
    joined = large.select("cluster", "id").join(connected_components(first), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = joined.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = materialise(counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1"), "main")
    status = materialise(joined.join(main, "cluster").select("id", "component", (F.col("component") != F.col("main")).alias("outside")), "status")
    if status.isEmpty():
        return first
    members = materialise(large.join(status, "id"), "outsiders")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            token, n = np.unique(np.concatenate(_sets(t, "shingles")), return_counts=True)
            kept = np.argsort(-n, kind="stable")[:FREQUENT]
            kept = np.sort(kept[n[kept] > 1])  # by token
            columns = [t.column("cluster")[:1].combine_chunks(), t.column("size")[:1].combine_chunks(), pa.array([token[kept].tobytes()]), pa.array([n[kept].astype(np.uint64).tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "size", "shingles", "n"])

    some = counted.join(main.select("cluster"), "cluster", "left_semi").select("cluster", "size", "shingles").repartition("cluster").sortWithinPartitions("cluster")
    lists = some.mapInArrow(frequent, "cluster long, size long, shingles binary, n binary").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    nothing = lambda t: F.lit(None).cast(t)
    rows = members.select("cluster", "chunk", "id", "size", "component", "outside", "shingles", nothing("binary").alias("n")).unionByName(
        lists.select("cluster", "chunk", nothing("long").alias("id"), "size", nothing("long").alias("component"), nothing("boolean").alias("outside"), "shingles", "n")
    )
    schema = "cluster long, part long, id long, n long, component long, outside boolean, keys binary, places binary"
    beginnings = together(rows).mapInArrow(_beginnings(threshold), schema)
    pairs = beginnings.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_meeting(threshold), "a long, b long")
    return first.unionByName(_verified(materialise(pairs.distinct(), "pairs"), members, threshold))


# If two sets reach the threshold and are put in one order of tokens, then the beginning of the longer (all but a share
# ``threshold`` of its length, and one more) and a shorter beginning of the other hold a common token, the first of all,
# from which on enough of either is left.


def _beginnings(threshold: tuple[int, int]):
    """A map over chunks of members and their cluster's frequent tokens: the beginning of each member's ordered set, a row for each part of the token space."""
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            common, weight = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            out: list[tuple] = []
            rows = sorted(t.to_pylist(), key=lambda r: r["id"] is not None)  # the list comes first
            for r in rows:
                tokens = np.frombuffer(r["shingles"], np.uint64)
                if r["id"] is None:
                    common, weight = tokens, np.frombuffer(r["n"], np.uint64)
                    continue
                n = len(tokens)
                most = n - -(-up * n // down) + 1
                at = np.searchsorted(common, tokens)
                count = np.zeros(n, np.uint64)
                if len(common):
                    at[at == len(common)] = 0
                    count = np.where(common[at] == tokens, weight[at], 0)
                chosen = np.lexsort((tokens, count))[:most]
                keys, places = tokens[chosen], np.arange(len(chosen), dtype=np.int64)
                part = (keys % np.uint64(-(-r["size"] // CHUNK))).astype(np.int64)
                by_part = np.argsort(part, kind="stable")
                part, keys, places = part[by_part], keys[by_part], places[by_part]
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
                for low, high in zip(cuts, [*cuts[1:], len(part)]):
                    out.append((r["cluster"], int(part[low]), r["id"], n, r["component"], r["outside"], keys[low:high].tobytes(), places[low:high].tobytes()))
            names = ["cluster", "part", "id", "n", "component", "outside", "keys", "places"]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    return run


def _meeting(threshold: tuple[int, int]):
    """A map over the parts of clusters: pairs of members that share a token of their beginnings, within the bounds."""
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            found = [np.frombuffer(b, np.uint64) for b in t.column("keys").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            key = np.concatenate(found)
            place = np.concatenate([np.frombuffer(b, np.int64) for b in t.column("places").to_pylist()])
            ids, size, component, outside = (t.column(c).to_numpy() for c in ("id", "n", "component", "outside"))
            n = size[row]
            early = np.flatnonzero(place < n - -(-2 * up * n // (up + down)) + 1)
            early = early[np.argsort(key[early], kind="stable")]
            low, high = np.searchsorted(key[early], key, "left"), np.searchsorted(key[early], key, "right")
            done = 0
            while done < len(key):  # as many matches at a time as memory holds
                upto = max(done + 1, int(np.searchsorted(np.cumsum(high[done:] - low[done:]), 2_000_000)) + done)
                length = high[done:upto] - low[done:upto]
                p = np.repeat(np.arange(done, upto), length)
                i = early[np.repeat(low[done:upto] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
                x, y = row[p], row[i]
                fits = (component[x] != component[y]) & (outside[x] | outside[y]) & (size[y] <= size[x]) & (up * size[x] <= down * size[y])
                fits &= (up + down) * np.minimum(size[x] - place[p], size[y] - place[i]) >= up * (size[x] + size[y])
                x, y = ids[x[fits]], ids[y[fits]]
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                done = upto

    return run


def _verified(pairs: DataFrame, members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Pairs between two chunks of a cluster are decided together: a set travels once for each chunk that it meets, not for
    each pair.
    """
    up, down = threshold
    place = members.select("id", "cluster", "chunk")
    of = lambda c: place.select(F.col("id").alias(c), "cluster", F.col("chunk").alias(f"chunk_{c}"))
    met = pairs.join(of("a"), "a").join(of("b").drop("cluster"), "b")
    met = materialise(met.select("a", "b", "cluster", F.least("chunk_a", "chunk_b").alias("low"), F.greatest("chunk_a", "chunk_b").alias("high")), "met")
    block = ["cluster", "low", "high"]
    needed = met.select(*block, F.col("a").alias("id")).union(met.select(*block, F.col("b").alias("id"))).distinct().join(members.select("id", "shingles"), "id")
    none = lambda t: F.lit(None).cast(t)
    rows = needed.select(*block, "id", none("long").alias("b"), "shingles").unionByName(met.select(*block, F.col("a").alias("id"), "b", none("binary").alias("shingles")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            ids, others = t.column("id").to_numpy(), t.column("b")
            is_pair = np.asarray(others.combine_chunks().is_valid())
            sets = {int(i): np.frombuffer(x, np.uint64) for i, x in zip(ids[~is_pair], t.column("shingles").filter(pa.array(~is_pair)).to_pylist())}
            found = []
            for a, b in zip(ids[is_pair].tolist(), others.filter(pa.array(is_pair)).to_pylist()):
                x, y = sets[a], sets[b]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if down * shared >= up * (len(x) + len(y) - shared):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    together = rows.repartition(*block).sortWithinPartitions(*block)
    return materialise(together.mapInArrow(verify, "a long, b long"), "links")
