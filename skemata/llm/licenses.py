"""License scans by patience alignment.

A text and a template are aligned on the words that occur once in both: the longest
increasing subsequence of these anchors stands, and the gaps between them are aligned
in the same way, where other words are now unique.  A gap without anchors matches its
common beginning and end.  Coverage is the share of the template's words that are
aligned; a match needs ``coverage`` or more.

Where to align is found first, over all words of the whole text: the tightest places
that hold as many of the template's words as the coverage needs.  Such a place is
widened on both sides as long as more words align, with no limit on the length of a
match; but between two aligned words that follow each other lie fewer than twice as
many other words as the template has, else they belong to different matches.  Each
copy in a text is a row.  Patience alignment is not a longest common subsequence: a
text whose words are repeated and out of order can align fewer words than it might.

``required`` names words of a template that must be aligned whatever the coverage,
``excluded`` words that must not lie in a match: they tell variants of a licence apart.

Words are runs of letters, digits and bytes above ASCII, A-Z lower-cased.

Defined cases: null and empty texts have no match; equal rows have equal matches;
templates without words are never found; templates that cover the same place are all
reported; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemata.llm.wordhash import byte_view, span_hashes, text_slices, word_spans

# The wording of public licences and of the notices that name them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you
may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.""",
}

_GNU = TEMPLATES["GPL-3.0-header"]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
TEMPLATES |= {
    f"CC-{kind}-4.0-notice": f"Licensed under CC {kind} 4.0."
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")
} | {
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-2.0-header": _GNU.replace("version 3", "version 2"),
    "LGPL-3.0-header": _GNU.replace("GNU General", "GNU Lesser General"),
    "AGPL-3.0-header": _GNU.replace("GNU General", "GNU Affero General"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License,
v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + """ Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific
prior written permission.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is
free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
# Words without which a text does not state that licence: those that tell it from its
# variants, and of a notice that it puts a work under it.
REQUIRED = {
    "MIT-notice": "under MIT",
    "Apache-2.0-notice": "under Apache 2",
    "Apache-2.0-header": "Apache 2",
    "GPL-3.0-notice": "under GNU 3",
    "GPL-2.0-notice": "under GNU 2",
    "LGPL-2.1-notice": "under GNU Lesser 2 1",
    "LGPL-3.0-notice": "under GNU Lesser 3",
    "AGPL-3.0-notice": "under GNU Affero 3",
    "GPL-3.0-header": "GNU 3",
    "GPL-2.0-header": "GNU 2",
    "LGPL-3.0-header": "GNU Lesser 3",
    "AGPL-3.0-header": "GNU Affero 3",
    "MPL-2.0-notice": "under Mozilla 2",
    "MPL-2.0-header": "Mozilla 2",
    "BSD-2-Clause-notice": "under BSD 2",
    "BSD-3-Clause-notice": "under BSD 3",
    "BSD-3-Clause": "neither endorse promote",
    "CC0-1.0-notice": "under CC0",
    "Unlicense": "unencumbered",
} | {n: f"under {n[:-11]} 4" for n in TEMPLATES if n.startswith("CC-")}
# Words that between the first and the last aligned word make it another variant.
EXCLUDED = {
    n: " ".join({"NC", "SA", "ND"} - set(n.split("-"))) for n in TEMPLATES if n.startswith("CC-")
} | {n: "Lesser Affero Library" for n in TEMPLATES if n.startswith("GPL-")}

_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
# how far apart, in lengths of the template, aligned words that follow each other may be
GAP = 2


def scan_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, text offsets into them, and the words' byte starts and ends."""
    data, offsets = byte_view(texts)
    starts, ends = word_spans(data, offsets, _GAPS)
    bounds = np.searchsorted(starts, offsets)
    origin = np.repeat(offsets[:-1], np.diff(bounds))
    return span_hashes(data, starts, ends, True), bounds, starts - origin, ends - origin


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
        back.append(piles[at - 1] if at else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, both increasing."""
    out = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: a + i for i, w in enumerate(text[a:b]) if in_text[w] == 1}
        anchors = [
            (place[w], c + i)
            for i, w in enumerate(template[c:d])
            if in_template[w] == 1 and w in place
        ]
        anchors = [anchors[i] for i in increasing([p for p, _ in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True):
            if r - p > 1 and s - q > 1:
                work.append((p + 1, r, q + 1, s))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float, required: str = "", excluded: str = ""):
        self.name = name
        self.words = scan_words(pa.array([text]))[0].tolist()
        self.distinct = np.unique(np.array(self.words, dtype=np.uint64))
        self.counts = Counter(self.words)
        self.least = max(1, ceil(coverage * len(self.words) - 1e-9))
        self.gap = GAP * len(self.words)
        self.required = set(scan_words(pa.array([required]))[0].tolist())
        self.excluded = set(scan_words(pa.array([excluded]))[0].tolist())

    def matches(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(aligned words, first word, end word) of each match; ``at``: the positions
        in ``words`` that hold a word of any template."""
        here = at[np.isin(words[at], self.distinct)]
        cuts = np.flatnonzero(np.diff(here) > self.gap) + 1
        for run in np.split(here, cuts):
            if len(run) >= self.least:
                yield from self._in_run(words, run)

    def _in_run(self, words: np.ndarray, run: np.ndarray) -> Iterator[tuple[int, int, int]]:
        places, held = run.tolist(), words[run].tolist()
        bound, have, n, left, right = places[0], Counter(), 0, 0, 0
        while right < len(places):
            have[held[right]] += 1
            n += have[held[right]] <= self.counts[held[right]]
            right += 1
            if n < self.least:
                continue
            # the tightest place that ends here
            while have[held[left]] > self.counts[held[left]] or n > self.least:
                n -= have[held[left]] <= self.counts[held[left]]
                have[held[left]] -= 1
                left += 1
            best = self._widened(words, places[left], places[right - 1] + 1, bound, places[-1] + 1)
            if best:
                bound = best[-1][0] + 1
                yield len(best), best[0][0], bound
                left = right = bisect_left(places, bound)
                have, n = Counter(), 0
            else:
                have[held[left]] -= 1
                n -= 1
                left += 1

    def _widened(
        self, words: np.ndarray, begin: int, end: int, low: int, high: int
    ) -> list[tuple[int, int]]:
        """Best alignment around a place, between ``low`` and ``high``; empty if too small."""
        size = len(self.words)
        best: list[tuple[int, int]] = []
        # a copy next to another one would take away what is unique, so the
        # template's own length is tried before longer stretches
        spans = [(begin, begin + size), (end - size, end), (begin, end)]
        more, idle = max(1, size - self.least), 0
        while len(best) < size and idle < 2:
            if spans:
                a, b = spans.pop(0)
            else:
                a, b = begin - more, end + more
                more, idle = 2 * more, idle + 1
            pairs = align(words[max(a, low) : min(b, high)].tolist(), self.words)
            pairs = self._together([(p + max(a, low), q) for p, q in pairs])
            if len(pairs) > len(best):
                best, idle = pairs, 0
            if a <= low and b >= high:
                break
        aligned = {self.words[q] for _, q in best}
        if len(best) < self.least or not self.required <= aligned:
            return []
        inside = words[best[0][0] : best[-1][0] + 1].tolist() if self.excluded else []
        return [] if self.excluded.intersection(inside) else best

    def _together(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest stretch of aligned words without too wide a gap."""
        cuts = [i for i in range(1, len(pairs)) if pairs[i][0] - pairs[i - 1][0] > self.gap]
        edges = [0, *cuts, len(pairs)]
        return max((pairs[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)), key=len)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    coverage: float = 0.8,
    required: Mapping[str, str] = REQUIRED,
    excluded: Mapping[str, str] = EXCLUDED,
) -> DataFrame:
    """One row per match: id, ``license_id``, ``coverage``, ``n_aligned``, ``first_word``,
    ``end_word``, ``first_byte``, ``end_byte`` and ``matched`` (the text in between)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known, needed, barred = dict(templates), dict(required), dict(excluded)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [
            Template(n, t, coverage, needed.get(n, ""), barred.get(n, "")) for n, t in known.items()
        ]
        made = [t for t in made if t.words]
        if not made:
            return
        vocabulary = np.unique(np.concatenate([t.distinct for t in made]))
        counts = np.array([[t.counts[w] for w in vocabulary.tolist()] for t in made])
        needs = np.array([[w in t.required for w in vocabulary.tolist()] for t in made])
        least = np.array([t.least for t in made])
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        for part in text_slices(batches, 1, 1 << 20):
            words, bounds, starts, ends = scan_words(part.column(1))
            maybe = np.flatnonzero(seen[(words >> np.uint64(48)).astype(np.int64)])
            hits = maybe[np.isin(words[maybe], vocabulary)]
            codes = np.searchsorted(vocabulary, words[hits])
            cuts = np.searchsorted(hits, bounds)
            out = []
            for i in np.flatnonzero(np.diff(cuts) >= least.min()).tolist():
                # templates of which the whole text holds enough words, and the required ones
                held = np.bincount(codes[cuts[i] : cuts[i + 1]], minlength=len(vocabulary))
                enough = np.minimum(counts, held).sum(axis=1) >= least
                enough &= (needs <= (held > 0)).all(axis=1)
                a, b = int(bounds[i]), int(bounds[i + 1])
                at = hits[cuts[i] : cuts[i + 1]] - a
                raw = None
                for t in [made[k] for k in np.flatnonzero(enough).tolist()]:
                    for n, first, end in t.matches(words[a:b], at):
                        raw = raw or part.column(1)[i].as_py().encode()
                        low, high = int(starts[a + first]), int(ends[a + end - 1])
                        out.append(
                            (
                                part.column(0)[i].as_py(), t.name, n / len(t.words), n, first, end,
                                low, high, raw[low:high].decode(),
                            )
                        )
            if out:
                kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=[
                        "doc_id", "license_id", "coverage", "n_aligned", "first_word", "end_word",
                        "first_byte", "end_byte", "matched",
                    ],
                )

    return rows.mapInArrow(
        found,
        "doc_id long, license_id string, coverage double, n_aligned long, first_word long, "
        "end_word long, first_byte long, end_byte long, matched string",
    )
