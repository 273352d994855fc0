"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; hashes of runs of ``RUN`` words are winnowed (Schleimer, Wilkerson and Aiken, 2003): of
every ``SPAN`` runs in a row the least hash is a fingerprint. An inverted index leads from a fingerprint to templates
and positions. A document's words that no template has break it into segments; the hashes of all runs of these segments
are looked up; each hit that no match of its template covers yet is aligned with the template inside a band around its
diagonal, between the matches already found. Templates shorter than a winnowing window are fingerprinted by all their runs.

Defined cases: a null or empty text has no match; repeated rows are scanned alike; an empty table gives an empty
result; a text that holds a template several times has a match for each; further columns are ignored. Spans are in code
points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Well-known license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
        "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

#: Words of a run, runs of a winnowing window, half width of the alignment band, and least share of a template's words.
RUN, SPAN, BAND, COVERAGE = 3, 4, 8, 0.8
#: Characters of all templates that are read from files.
MOST_CHARS = 20_000_000

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def fingerprints(words: list[str]) -> list[tuple[int, int]]:
    """(hash, position) of the winnowed runs."""
    hashes = [xxhash.xxh3_64_intdigest("\x00".join(words[i : i + RUN])) for i in range(len(words) - RUN + 1)]
    if len(hashes) < SPAN:
        return list(zip(hashes, range(len(hashes))))
    chosen = {min(range(i, i + SPAN), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - SPAN + 1)}
    return [(hashes[i], i) for i in sorted(chosen)]


def align(doc: list[str], template: list[str], shift: int, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Longest common subsequence of words as (document, template) positions, within ``BAND`` of the diagonal document - template = shift.

    Only the document's words from ``low`` to before ``high`` take part. Of equally long ones it is one that starts last, so
    that a match doesn't reach back into what stands before a whole notice.
    """
    n, width, high = len(template), 2 * BAND + 1, len(doc) if high is None else high
    best = [[0] * (width + 1) for _ in range(n + 1)]
    for t in range(n - 1, -1, -1):
        row, after = best[t], best[t + 1]
        for o in range(width - 1, -1, -1):
            d = t + shift + o - BAND
            # The band moves with the template: the same offset one word on is the diagonal, offset - 1 skips a template word.
            skip = max(row[o + 1], after[o - 1] if o else 0)
            same = low <= d < high and doc[d] == template[t]
            row[o] = max(skip, after[o] + 1) if same else skip
    found, t, o = [], 0, 0
    while o + 1 < width and best[0][o + 1] == best[0][0]:
        o += 1
    while t < n and o < width:
        d = t + shift + o - BAND
        if low <= d < high and doc[d] == template[t] and best[t][o] == best[t + 1][o] + 1:
            found.append((d, t))
            t += 1
        elif best[t][o] == best[t][o + 1]:
            o += 1
        else:
            t, o = t + 1, o - 1
    return found


class Scanner:
    """Templates, their vocabulary and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.needed = [max(1, math.ceil(coverage * len(words) - 1e-9)) for words in self.words]
        self.vocabulary = {w for words in self.words for w in words}
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            # A document may hold less than a window of context: all runs of a short template count.
            marks = fingerprints(words) if len(words) >= 2 * (RUN + SPAN) else [(xxhash.xxh3_64_intdigest("\x00".join(words[i : i + RUN])), i) for i in range(len(words) - RUN + 1)]
            for h, at in marks:
                self.index[h].append((k, at))

    def matches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end), by start, then template; of overlapping ones the longest match stays."""
        where = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in where]
        known = np.array([w in self.vocabulary for w in words], bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]])))
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            segment = words[low:high]
            marks = [(xxhash.xxh3_64_intdigest("\x00".join(segment[i : i + RUN])), i) for i in range(len(segment) - RUN + 1)]
            for h, at in marks:
                for k, position in self.index.get(h, ()):
                    hits[k].add((low + at - position, low + at))
        found = []
        for k, places in hits.items():
            # The template's matches, disjoint and in order: where they start and end.
            template, starts, ends, tried = self.words[k], [], [], set()
            of_template = Counter(template)
            for shift, at in sorted(places):
                # Until no match covers this hit: other notices in the band may be found first. A match never crosses another.
                while True:
                    i = bisect_right(starts, at)
                    low, high = ends[i - 1] if i else 0, starts[i] if i < len(starts) else len(words)
                    if at < low or (shift, low, high) in tried:
                        break
                    tried.add((shift, low, high))
                    centre = shift + BAND // 2
                    inside = Counter(words[max(low, centre - BAND) : max(0, min(high, centre + BAND + len(template)))])
                    if (of_template & inside).total() < self.needed[k]:
                        break  # too few words of the template for any alignment
                    pairs = align(words, template, centre, low, high)
                    if len(pairs) < self.needed[k]:
                        break
                    i = bisect_right(starts, pairs[0][0])
                    starts.insert(i, pairs[0][0])
                    ends.insert(i, pairs[-1][0] + 1)
                    found.append((self.names[k], len(pairs) / len(template), len(pairs), where[pairs[0][0]][0], where[pairs[-1][0]][1]))
        found.sort(key=lambda m: (-m[2], m[3], m[0]))
        kept: list[tuple] = []
        for m in found:
            i = bisect_right(kept, m[3], key=lambda o: o[3])
            if (not i or kept[i - 1][4] <= m[3]) and (i == len(kept) or m[4] <= kept[i][3]):
                kept.insert(i, m)
        return kept


def templates_of(spark: SparkSession, path: str) -> dict[str, str]:
    """Texts of a folder as templates, named after their files; each index holds all of them, so they may be ``MOST_CHARS`` at most."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[a-z]+)?$", 1).alias("name"), "value")
    size = texts.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"templates of {size} characters are too large for every task to hold")
    return {r.name: r.value for r in texts.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per match: doc_id, template, coverage, matched_words, start, end. A map over the scan: nothing is shuffled."""
    chosen = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            out = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scanner.matches(text.as_py() or "")]
            if out:
                doc_id, name, share, matched, start, end = zip(*out)
                columns = [pa.array(doc_id, pa.int64()), pa.array(name, pa.string()), pa.array(share, pa.float64()), *(pa.array(c, pa.int64()) for c in (matched, start, end))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "template", "coverage", "matched_words", "start", "end"])

    schema = "doc_id long, template string, coverage double, matched_words long, start long, end long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
