"""Scans of Arrow string buffers with NumPy: byte classes, prefix sums at the texts' ends, distinct words.

Texts are looked at where Arrow holds them, as bytes; no string objects are made. Counts go by blocks of bytes that need
not end where a text does, so that they take the same memory however long a text is. Distinct words take about 40 bytes
a word of one slice of texts, or of one text where it is longer than a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a block, and of the texts whose words are told apart together.
BLOCK = 1 << 20
#: Texts of such a slice at most: their numbers fill the bits of a key that the word hash leaves.
SLICE_TEXTS = 1 << 14
HASH_BITS = 48
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 256

SPACE, CAPITAL, SYMBOL, HEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= SPACE
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] |= CAPITAL
_CLASS[list(b"#$%&*|")] |= SYMBOL
#: All bytes but those that continue a code point.
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= HEAD

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of a string column and the places where its texts begin, with the last one's end; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(at: np.ndarray):
    """Ranges (low, high) of texts that hold up to ``BLOCK`` bytes, or one longer text."""
    low = 0
    while low < len(at) - 1:
        high = int(np.searchsorted(at, at[low] + BLOCK, "right")) - 1
        high = min(max(high, low + 1), low + SLICE_TEXTS, len(at) - 1)
        yield low, high
        low = high


def _blocks(data: np.ndarray, at: np.ndarray):
    """Per block: first byte, classes, the texts it touches, and where these begin and end inside."""
    for low in range(int(at[0]), int(at[-1]), BLOCK):
        high = min(low + BLOCK, int(at[-1]))
        first, last = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, high, "left"))
        yield low, _CLASS[data[low:high]], slice(first, last), np.clip(at[first : last + 1], low, high) - low


def _edges(data: np.ndarray, at: np.ndarray, low: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of a block begin a word, and which end one: next to white space or to an end of their text."""
    inside = (kinds & SPACE) == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    high = low + len(kinds)
    if low > at[0]:
        first[0] &= bool(_CLASS[data[low - 1]] & SPACE)
    if high < at[-1]:
        last[-1] &= bool(_CLASS[data[high]] & SPACE)
    # A text's own first and last byte have no neighbour that counts.
    begins = at[np.searchsorted(at, low, "left") : np.searchsorted(at, high, "left")] - low
    first[begins] = inside[begins]
    ends = at[np.searchsorted(at, low, "right") : np.searchsorted(at, high, "right")] - low - 1
    last[ends] = inside[ends]
    return first, last


def _within(mask: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many bytes of ``mask`` lie between neighbouring cuts."""
    sums = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[cuts])


def count(data: np.ndarray, at: np.ndarray, *classes: int) -> list[np.ndarray]:
    """Per text: its words, then the bytes of each class asked for."""
    out = [np.zeros(len(at) - 1, np.int64) for _ in range(len(classes) + 1)]
    for low, kinds, where, cuts in _blocks(data, at):
        out[0][where] += _within(_edges(data, at, low, kinds)[0], cuts)
        for total, kind in zip(out[1:], classes):
            total[where] += _within((kinds & kind) != 0, cuts)
    return out


class _Words:
    """Eight bytes at a time of any place in a buffer."""

    def __init__(self, data: np.ndarray, low: int, high: int):
        self.raw = np.zeros(high - low + 8, np.uint8)
        self.raw[:-8] = data[low:high]
        self.low = low
        self.eights = np.ndarray(high - low + 1, "<u8", self.raw.data, strides=(1,))

    def part(self, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of the words, zeros behind their ends; all of them reach so far."""
        rest = np.minimum(lengths - 8 * k, 8).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
        return self.eights[starts - self.low + 8 * k] & keep

    def bytes(self, start: int, length: int) -> bytes:
        return self.raw[start - self.low : start - self.low + length].tobytes()


def _hashes(words: _Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = lengths.astype(np.uint64)
    active, k = np.flatnonzero(lengths <= LONG_WORD), 0
    while len(active):
        mixed = (out[active] ^ words.part(starts[active], lengths[active], k)) * _FACTOR
        out[active] = mixed ^ (mixed >> np.uint64(29))
        k += 1
        active = active[lengths[active] > 8 * k]
    out *= _FACTOR  # the upper bits, which the keys hold, depend on all
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words.bytes(int(starts[i]), int(lengths[i])))
    return out


def _same(words: _Words, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words ``a`` and ``b`` are equal, pair by pair, by their bytes."""
    equal = lengths[a] == lengths[b]
    active, k = np.flatnonzero(equal & (lengths[a] <= LONG_WORD)), 0
    while len(active):
        x, y = a[active], b[active]
        alike = words.part(starts[x], lengths[x], k) == words.part(starts[y], lengths[y], k)
        equal[active[~alike]] = False
        k += 1
        active = active[alike & (lengths[x] > 8 * k)]
    for i in np.flatnonzero(equal & (lengths[a] > LONG_WORD)).tolist():
        n = int(lengths[a[i]])
        equal[i] = words.bytes(int(starts[a[i]]), n) == words.bytes(int(starts[b[i]]), n)
    return equal


def distinct_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text of one slice: how many words differ.

    Keys of text and word hash are sorted; neighbours with one key are compared by their bytes. Where these differ, two
    words share a hash, and the text's words are told apart by a set instead.
    """
    firsts, ends = [], []
    for low, kinds, _, _ in _blocks(data, at):
        first, last = _edges(data, at, low, kinds)
        firsts.append(np.flatnonzero(first) + low)
        ends.append(np.flatnonzero(last) + low + 1)
    if not firsts:
        return np.zeros(len(at) - 1, np.int64)
    starts = np.concatenate(firsts)
    lengths = np.concatenate(ends) - starts
    words = _Words(data, int(at[0]), int(at[-1]))
    text = np.searchsorted(at, starts, "right") - 1
    keys = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (_hashes(words, starts, lengths) >> np.uint64(64 - HASH_BITS))
    order = np.argsort(keys)
    keys = keys[order]
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    equal = _same(words, starts, lengths, order[again - 1], order[again])
    n = len(at) - 1
    found = np.bincount(text, minlength=n) - np.bincount(text[order[again[equal]]], minlength=n)
    for t in np.unique(text[order[again[~equal]]]).tolist():
        low, high = np.searchsorted(text, [t, t + 1])
        found[t] = len({words.bytes(s, k) for s, k in zip(starts[low:high].tolist(), lengths[low:high].tolist())})
    return found
