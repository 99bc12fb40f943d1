"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A template of m shingles is sought in windows of 2 s shingles that begin every s shingles, with s the template's
size class (s >= m, at most 1.5 m or m + 1), so every occurrence lies in some window. A window that holds the
share ``least`` of a template has at least the Jaccard similarity least * m / (2 s + (1 - least) * m) with it. The number of one-row
bands is set from the smallest such similarity so that a match stays unseen with probability ``miss`` at most.
A window whose minimum equals a template's in any band is a candidate; candidates are verified exactly: of the
template's distinct shingles, at least ``least`` must be in the window.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z in lower case; shingles are five
words. Documents are read once and never shuffled; templates are a parameter, broadcast, at most
``MAX_TEMPLATE_BYTES`` bytes together.

Defined results: null or empty text, or text of fewer than five words, has no match; templates of fewer than
five words are refused; overlapping windows of one template that match are reported as one span of words from
the first to the last shared shingle; repeated rows are treated alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import ALNUM, Words, mix, pieces, shingles, utf8

MAX_TEMPLATE_BYTES = 16 << 20

#: Public license notices, fixed texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Parts of public license texts, fixed texts.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Whole texts. The text of BSD-2-Clause is all in that of BSD-3-Clause, so both are found in the latter; the clause tells them apart.
TEMPLATES |= {"MIT-text": _MIT_GRANT, "BSD-2-Clause-text": f"{_BSD_TWO}\n{_BSD_DISCLAIMER}", "BSD-3-Clause-text": f"{_BSD_TWO}\n{_BSD_THIRD}\n{_BSD_DISCLAIMER}", "BSD-3-Clause-third": _BSD_THIRD, "ISC-text": _ISC}


def size_class(m: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, ... that is m or more."""
    s = 1
    while s < m:
        s = s * 3 // 2 if s & (s - 1) == 0 and s > 1 else (s * 4 // 3 if s > 1 else 2)
    return s


def bands_needed(similarity: float, miss: float) -> int:
    """Bands of one row with which a pair of the similarity is missed with the probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-similarity))) if similarity < 1 else 1


def _hashes(text: str, k: int) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    words = Words(data, offsets, ALNUM)
    if words.count[0] < k:
        raise ValueError(f"a template needs {k} words: {text!r}")
    return np.unique(shingles(words, k)[0])


class Index:
    """Templates by size class, with their minimum of each band."""

    def __init__(self, templates: dict[str, str], k: int = 5, least: float = 0.75, miss: float = 1e-6):
        if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError("templates are too large to broadcast")
        self.k, self.least = k, least
        self.names = sorted(templates)
        self.sets = [_hashes(templates[n], k) for n in self.names]
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            classes.setdefault(size_class(len(s)), []).append(i)
        self.classes = sorted(classes.items())
        lowest = min((least * len(s) / (2 * size_class(len(s)) + (1 - least) * len(s)) for s in self.sets), default=1.0)
        self.bands = bands_needed(lowest, miss)
        self.seeds = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.minima = [np.array([self.permute(s, b).min() for b in range(self.bands)]) for s in self.sets]

    def permute(self, h: np.ndarray, band: int) -> np.ndarray:
        x = (h ^ self.seeds[band]) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(29))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first shingle, end) of windows that meet a template in a band; ``first``: where each text begins."""
        if not len(h):
            return []
        plan = []
        for s, members in self.classes:
            n = -(-np.diff(first) // s)
            block = np.repeat(first[:-1], n) + s * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            end = np.minimum(block + 2 * s, np.repeat(first[1:], n))
            tail = np.concatenate([block[1:] != block[:-1] + s, [True]]) | (end <= block + s)
            plan.append((members, block, end, tail, np.zeros((len(members), len(block)), bool)))
        for b in range(self.bands):
            x = self.permute(h, b)
            for members, block, _, tail, met in plan:
                least = np.minimum.reduceat(x, block)
                pair = least.copy()
                pair[:-1] = np.where(tail[:-1], pair[:-1], np.minimum(least[:-1], least[1:]))
                for j, i in enumerate(members):
                    met[j] |= pair == self.minima[i][b]
        return [(i, int(block[w]), int(end[w])) for members, block, end, _, met in plan for j, i in enumerate(members) for w in np.flatnonzero(met[j])]

    def verified(self, h: np.ndarray, template: int, lo: int, hi: int) -> tuple[float, int, int] | None:
        """Containment, and the first and last shared shingle, of a window that holds enough of the template."""
        own = self.sets[template]
        at = np.minimum(np.searchsorted(own, h[lo:hi]), len(own) - 1)
        shared = own[at] == h[lo:hi]
        part = len(np.unique(at[shared])) / len(own)
        if part < self.least:
            return None
        places = np.flatnonzero(shared)
        return part, lo + int(places[0]), lo + int(places[-1])


def scan_part(index: Index, texts: pa.Array) -> list[list[dict]]:
    """Matches of each text: license, first word, end word, containment."""
    data, offsets = utf8(texts)
    words = Words(data, offsets, ALNUM)
    h, row = shingles(words, index.k)
    long_ = words.count[row] >= index.k if len(row) else np.zeros(0, bool)
    h, row = h[long_], row[long_]
    first = np.searchsorted(row, np.arange(len(words.count) + 1))
    out: list[list[dict]] = [[] for _ in words.count]
    for i, lo, hi in sorted(index.candidates(h, first)):
        found = index.verified(h, i, lo, hi)
        if found is None:
            continue
        r = int(row[lo])
        part, a, b = found[0], found[1] - int(first[r]), found[2] - int(first[r]) + index.k
        mine = out[r]
        if mine and mine[-1]["license"] == index.names[i] and a <= mine[-1]["end_word"]:
            mine[-1]["end_word"] = max(mine[-1]["end_word"], b)
            mine[-1]["containment"] = max(mine[-1]["containment"], part)
        else:
            mine.append({"license": index.names[i], "first_word": a, "end_word": b, "containment": part})
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", **args) -> DataFrame:
    """``key`` and ``matches`` (license, first_word, end_word, containment), by license and place."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, **args))
    src = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(scan_part(shared.value, part.column("t")), kind)], ["k", "matches"])

    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, matches array<struct<license:string,first_word:int,end_word:int,containment:double>>")
    return out.withColumnRenamed("k", key)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.expr("array_join(array_distinct(transform(matches, m -> m.license)), ',')").alias("licenses"), F.expr("array_join(transform(matches, m -> concat_ws(':', m.license, cast(m.first_word as string), cast(m.end_word as string))), ',')").alias("spans"))
