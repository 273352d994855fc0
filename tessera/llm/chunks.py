"""Encoding of texts by chunks: a cut at a space between two characters that aren't white space is a cut of the pre-tokens.

The pattern that splits text before byte-level merges lets a space stand only at the head of a pre-token or inside a
run of white space. So a text falls into chunks "word", " word", " word" ... whose encodings don't depend on each
other; few distinct chunks make up most of a corpus, and each is encoded once per worker while it stays in the cache.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

#: Bounds of the cache: chunks, and characters of a chunk.
MOST_CHUNKS, MOST_CHARS = 500_000, 40

#: White space other than spaces and line feeds.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def packed(ids: list[int]) -> bytes:
    """Ids as 16-bit numbers."""
    return array("H", ids).tobytes()


class ChunkEncoder:
    """Texts to ids by ``encode_many``, which takes strings and returns packed ids."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many = encode_many
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words of all texts are looked up together, so that no loop over words runs in Python."""
        chunks, ends, apart = [], [], []
        for text in texts:
            words = text.split(" ")
            if "" in words or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
                chunks += self._merged(words)
            else:
                apart.append(len(chunks))
                chunks += words
            ends.append(len(chunks))
        # A text's first word has no space before it; it is marked by one behind it, as no other chunk ends in a space.
        # Marked chunks stand for all but the mark, others for themselves behind a space.
        for at in apart:
            chunks[at] += " "
        missing = set(chunks).difference(self.cache)
        if len(self.cache) + len(missing) > MOST_CHUNKS:
            self.cache.clear()
            missing = set(chunks)
        names = list(missing)
        self.cache.update(zip(names, self.encode_many([c[:-1] if c[-1:] == " " else " " + c for c in names])))
        ids = list(map(self.cache.__getitem__, chunks))
        for c in names:
            if len(c) > MOST_CHARS:
                del self.cache[c]
        return [np.frombuffer(b"".join(ids[low:high]), dtype=np.uint16) for low, high in zip([0, *ends], ends)]

    @staticmethod
    def _merged(words: list[str]) -> list[str]:
        """Chunks of a text with runs of white space, cut between other characters only; all are marked as whole ones."""
        chunks, part = [], [words[0]]
        clean = bool(words[0]) and not words[0][-1].isspace()
        for w in words[1:]:
            if clean and w and not w[0].isspace():
                chunks.append("".join(part) + " ")
                part = [" " + w]
            else:
                part.append(" " + w)
            clean = bool(w) and not w[-1].isspace()
        chunks.append("".join(part) + " ")
        return chunks
