"""Packing by lexical retrieval: a sharded BM25 inverted index returns unused neighbours for a seed, which fill its window.

1. Each text is read once and becomes token ids, written out with a signature: the token of least random
   priority among its rarer tokens, which alike documents tend to share. Document frequencies of all tokens are counted
   over the whole corpus; there are as many as the vocabulary has tokens.
2. Documents are dealt into ranges of (signature, id): even shares whatever the signatures, as ties are cut by id. A
   range is worked off in shards of bounded size, each with its own inverted index of BM25 impacts.
3. In a shard, whole windows are cut off long documents first. Then the longest unused document seeds a sequence, and
   its neighbours by BM25 fill it greedily: whole ones that fit, else the best neighbour is cut and its rest stays
   unused. What a shard can't fill goes on to the range's next shard, and at the end of the range it becomes sequences
   whose lengths are powers of two, so that no padding arises.

Defined cases: a null text is empty and has its final token only; rows are packed one by one, so repeated rows are
packed as often as they occur; a null id is packed like any other; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import materialise

#: Tokens of a window; the token that ends each document.
WINDOW, END = 2048, 1
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Tokens and documents of a shard, and tokens of a range.
SHARD_TOKENS, SHARD_DOCS, RANGE_TOKENS = 2_000_000, 2_000, 4_000_000
#: Tokens below this id come from the first merges and are everywhere; they don't sign a document.
COMMON_TOKENS = 1000
#: Longest run without a space that goes to the encoder whose time grows with the square of a run.
LONGEST_RUN = 1000


class Encoder:
    """Token ids of whole texts, as a tokenizers file with byte-level merges gives them.

    The file's merges are handed to tiktoken as ranks, which encodes the same way several times faster. Where ids don't
    rise with the merges, in texts that hold an added token, and in texts with very long runs, the file's own library
    encodes.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(path, pattern)

    @staticmethod
    def _ranks(path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        ids = [model["vocab"].get(c) for c in to_byte]
        for merge in model["merges"]:
            ids.append(model["vocab"].get("".join(merge.split(" ") if isinstance(merge, str) else merge)))
        if None in ids or sorted(ids[:256]) != list(range(256)) or ids[256:] != list(range(256, len(ids))):
            return None
        names = {i: t for t, i in model["vocab"].items()}
        ranks = {bytes(to_byte[c] for c in names[i]): i for i in range(len(ids))}
        return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the token that ends it."""
        raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
        spaces = np.flatnonzero(raw == 0x20)
        long_runs = np.diff(spaces, prepend=-1, append=len(raw)).max(initial=0) > LONGEST_RUN or any(" " * LONGEST_RUN in t for t in texts)
        return [self._one(t, long_runs and (max(map(len, t.split(" "))) > LONGEST_RUN or " " * LONGEST_RUN in t)) for t in texts]

    def _one(self, text: str, long_runs: bool) -> np.ndarray:
        if long_runs or self.ranks is None or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks(text)
        ids.append(END)
        return np.array(ids, self.dtype)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, whatever number of tasks it runs."""
    return Encoder(path, pattern)


def distinct_counts(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece number, token and count of every distinct token of each piece, by piece, then token: one sort for all."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(pieces), dtype=np.uint64), [len(p) for p in pieces])
    keys = np.sort(at << np.uint64(32) | np.concatenate(pieces).astype(np.uint64))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, counts = keys[first], np.diff(np.append(first, len(keys)))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def signatures(at: np.ndarray, token: np.ndarray, n: int, priorities: list[np.ndarray]) -> np.ndarray:
    """Per piece the least priorities of its rarer tokens, the first above the second, as one number; 0 without any."""
    rare = token >= COMMON_TOKENS
    at, token = at[rare], token[rare]
    out = np.zeros(n, np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    if len(first):
        high, low = (np.minimum.reduceat(p[token], first).astype(np.int64) for p in priorities)
        out[at[first]] = high << 32 | low
    return out


def token_table(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, ids (packed numbers), n, signature; and per partition of the scan a row with its document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        size = max(own.size, END + 1)
        priorities = [np.random.default_rng(seed).permutation(size) for seed in (11, 12)]
        frequency = np.zeros(size, np.int64)
        row = TaskContext.get().partitionId() << 33
        names = ["doc_id", "row", "ids", "n", "signature", "terms", "counts"]
        list_type = pa.list_(pa.int64())
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                found = own.encode([text or "" for text in part.column(1).to_pylist()])
                at, token, _ = distinct_counts(found)
                frequency += np.bincount(token, minlength=size)
                n, empty = len(found), pa.nulls(len(found), list_type)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.arange(row, row + n)), pa.array([x.tobytes() for x in found], pa.binary()),
                        pa.array([len(x) for x in found], pa.int64()), pa.array(signatures(at, token, n, priorities)), empty, empty,
                    ],
                    names,
                )
                row += n
        terms = np.flatnonzero(frequency)
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([terms.tolist()], list_type), pa.array([frequency[terms].tolist()], list_type)], names)

    schema = "doc_id long, row long, ids binary, n long, signature long, terms array<long>, counts array<long>"
    return materialise(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema), "tokens")


class Shard:
    """Unused document pieces and their inverted index of BM25 impacts."""

    def __init__(self, pieces: list[tuple], idf: np.ndarray, mean: float):
        self.pieces = pieces  # (doc_id, ids, start)
        rest = [ids[start:] for _, ids, start in pieces]
        self.left = np.array([len(x) for x in rest], np.int64)
        at, term, tf = distinct_counts(rest)
        weigh = idf[term] > 0
        at, self.terms, tf = at[weigh], term[weigh], tf[weigh]
        self.ends = np.searchsorted(at, np.arange(len(pieces) + 1))
        impacts = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[at] / mean))
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.impacts = at[order], impacts[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece, with the seed's terms as the query."""
        term = self.terms[self.ends[seed] : self.ends[seed + 1]]
        low, length = self.starts[term], self.starts[term + 1] - self.starts[term]
        at = np.repeat(low - np.append(0, np.cumsum(length))[: len(length)], length) + np.arange(int(length.sum()))
        return np.bincount(self.docs[at], weights=self.impacts[at], minlength=len(self.pieces))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces, best first, ties in order of place."""
        unused = np.flatnonzero(self.left)
        return unused[np.argsort(-self.scores(seed)[unused], kind="stable")]


class Packer:
    """Packs one range of documents, shard by shard."""

    def __init__(self, idf: np.ndarray, mean: float, first_sequence: int):
        self.idf, self.mean, self.sequence = idf, mean, first_sequence
        self.out: list[tuple] = []

    def _emit(self, parts: list[tuple]) -> None:
        """Writes the pieces (doc_id, ids, start, length) as one sequence."""
        offset = 0
        for doc_id, ids, start, length in parts:
            raw = ids[start : start + length].astype("<u4").tobytes()
            self.out.append((doc_id, start, length, zlib.crc32(raw), len(ids), self.sequence, offset))
            offset += length
        self.sequence += 1

    def pack(self, pieces: list[tuple], last: bool) -> list[tuple]:
        """Packs (doc_id, ids, start); returns pieces that are left, none if this is the ``last`` shard."""
        rest = []
        for doc_id, ids, start in pieces:
            while len(ids) - start >= WINDOW:
                self._emit([(doc_id, ids, start, WINDOW)])
                start += WINDOW
            if start < len(ids):
                rest.append((doc_id, ids, start))
        shard = Shard(rest, self.idf, self.mean)
        left, unused, total = shard.left, [(-n, i) for i, n in enumerate(shard.left.tolist())], int(shard.left.sum())
        heapq.heapify(unused)
        begin = [p[2] for p in rest]
        while total >= WINDOW:
            n, seed = heapq.heappop(unused)
            if left[seed] == 0 or -n != left[seed]:
                continue  # used, or cut since
            parts, room = [], WINDOW

            def take(i: int, length: int, parts: list = parts) -> None:
                parts.append((rest[i][0], rest[i][1], begin[i], length))
                begin[i] += length
                left[i] -= length

            room -= int(left[seed])
            take(seed, int(left[seed]))
            order, cut = shard.neighbours(seed) if room else (), None
            while room:
                # The next that fits; what is passed over first is the best neighbour that is too long.
                fits = np.flatnonzero(left[order] <= room)
                if cut is None and len(order) and not (len(fits) and fits[0] == 0):
                    cut = int(order[0])
                if not len(fits):
                    break
                i = int(order[fits[0]])
                order = order[fits[0] + 1 :]
                room -= int(left[i])
                take(i, int(left[i]))
            if room:  # the best neighbour that is too long
                take(cut, room)
                heapq.heappush(unused, (-int(left[cut]), cut))
            self._emit(parts)
            total -= WINDOW
        pieces = [(rest[i][0], rest[i][1], begin[i]) for i in np.flatnonzero(left).tolist()]
        return self._finish(pieces) if last else pieces

    def _finish(self, pieces: list[tuple]) -> list[tuple]:
        """The last tokens of the range, fewer than a window, in sequences whose lengths are powers of two."""
        total = sum(len(ids) - start for _, ids, start in pieces)
        at = 0
        for bit in reversed(range(WINDOW.bit_length())):
            if total >> bit & 1:
                parts, room = [], 1 << bit
                while room:
                    doc_id, ids, start = pieces[at]
                    length = min(room, len(ids) - start)
                    parts.append((doc_id, ids, start, length))
                    room -= length
                    pieces[at] = (doc_id, ids, start + length)
                    at += start + length == len(ids)
                self._emit(parts)
        return []


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    own = encoder(tokenizer_path, pattern)
    size, dtype = max(own.size, END + 1), own.dtype
    tokens = token_table(docs, tokenizer_path, pattern, id_col, text_col)
    rows = tokens.where("n is not null").select("doc_id", "row", "ids", "n", "signature")
    documents, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = tokens.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts"))
    idf = np.zeros(size)
    for term, df in counts.collect():  # one number for each token of the vocabulary
        idf[term] = max(0.0, math.log((documents - df + 0.5) / (df + 0.5)))
    weights = spark.sparkContext.broadcast(idf)  # as many numbers as the vocabulary has tokens
    mean = total / max(documents, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(weights.value, mean, TaskContext.get().partitionId() << 33)
        pieces: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.out:
                columns = [pa.array(c, pa.int64()) for c in zip(*packer.out)]
                packer.out = []
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(blob.as_py(), dtype)
                pieces.append((doc_id, ids, 0))
                held += len(ids)
                if held >= SHARD_TOKENS or len(pieces) >= SHARD_DOCS:
                    pieces = packer.pack(pieces, last=False)
                    held = sum(len(ids) - start for _, ids, start in pieces)
                    yield from flush()
        packer.pack(pieces, last=True)
        yield from flush()

    ranges = max(1, -(-total // RANGE_TOKENS))
    # The row number comes last: rows that repeat an id, or have none, are dealt like any others.
    order = ["signature", F.xxhash64("doc_id"), "doc_id", "row"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
