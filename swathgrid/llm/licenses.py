"""License scans by patience alignment.

Words unique to both text and template are anchors; the longest increasing subsequence of their positions is kept, and the
gaps between anchors are aligned in the same way. A gap without unique words is aligned by the longest common subsequence,
whatever its size: its sides are bounded by a run and the template. Coverage is the share of the template's words so aligned.

Whole texts are scanned: runs of words near template words are found first, and one is aligned, whole, only if the words it
shares with the template (as bags) could reach the threshold, a bound that loses nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

THRESHOLD = 0.8
#: A notice's aligned words stand within so many times its length.
SPREAD = 6

# Notices as their licences give them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k] = x
            at[k] = i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    """A longest common subsequence by bit rows (a number of len(b) bits for each word of a)."""
    place: dict = {}
    for j, w in enumerate(b):
        place[w] = place.get(w, 0) | 1 << j
    row = every = (1 << len(b)) - 1
    rows = [row]
    for w in a:
        u = row & place.get(w, 0)
        row = ((row + u) | (row - u)) & every
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        bit = 1 << j - 1
        if rows[i] & bit:  # word j of b adds nothing here
            j -= 1
        elif not rows[i - 1] & bit:  # nor does word i of a
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a0 + i, b0 + j))
    return out


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched positions (text, template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        a, b = text[a0:a1], template[b0:b1]
        ca, cb = Counter(a), Counter(b)
        place = {w: k for k, w in enumerate(a) if ca[w] == 1}
        pairs = [(place[w], k) for k, w in enumerate(b) if cb[w] == 1 and w in place]  # by template position
        chosen = [pairs[k] for k in increasing([p for p, _ in pairs])]
        if not chosen:
            out += _common(a, b, a0, b0)
            continue
        la, lb = a0, b0
        for i, j in [*chosen, (len(a), len(b))]:
            if i < len(a):
                out.append((a0 + i, b0 + j))
            todo.append((la, a0 + i, lb, b0 + j))
            la, lb = a0 + i + 1, b0 + j + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = [(name, words_of(t.encode())) for name, t in templates.items()]
        self.templates = [(n, t, Counter(t)) for n, t in self.templates if t]
        self.vocabulary: dict[bytes, list[int]] = {}
        for k, (_, _, bag) in enumerate(self.templates):
            for w in bag:
                self.vocabulary.setdefault(w, []).append(k)

    def scan(self, raw: bytes) -> list[tuple[str, float, int, int]]:
        """(template, best coverage, first and last aligned word) of the templates that reach the threshold."""
        words = words_of(raw)
        spots: dict[int, list[int]] = {}
        vocabulary = self.vocabulary
        for p, w in enumerate(words):
            if w in vocabulary:
                for k in vocabulary[w]:
                    spots.setdefault(k, []).append(p)
        out = []
        for k, places in sorted(spots.items()):
            name, template, bag = self.templates[k]
            need = self.threshold * len(template)
            if len(places) < need:
                continue
            best = None
            for low, high in self._runs(places, len(template)):
                for found in self._aligned(words, low, high, template, bag, need):
                    if best is None or len(found) > len(best):
                        best = found
            if best:
                out.append((name, len(best) / len(template), best[0][0], best[-1][0]))
        return out

    def _aligned(self, words: list, low: int, high: int, template: list, bag: Counter, need: float) -> Iterator[list]:
        """Alignments in words [low, high) that reach the threshold within ``SPREAD`` times the template's length.

        Windows of twice that length overlap by half. Where an alignment reaches further, narrower windows are aligned.
        """
        limit = SPREAD * len(template)
        for at in range(low, max(low + 1, high - limit), limit):
            end = min(high, at + 2 * limit)
            if not self._shares(words[at:end], bag, need):
                continue
            for a, b in [(at, end), *((k, min(end, k + limit)) for k in range(at, end, len(template)))]:
                if not self._shares(words[a:b], bag, need):
                    continue
                pairs = align(words[a:b], template)
                if len(pairs) >= need and pairs[-1][0] - pairs[0][0] < limit:
                    yield [(a + i, j) for i, j in pairs]
                    break
                if len(pairs) < need and a == at and b == end:
                    break

    @staticmethod
    def _shares(words: list, bag: Counter, need: float) -> bool:
        own = Counter(words)
        return sum(min(n, own[w]) for w, n in bag.items()) >= need

    @staticmethod
    def _runs(places: list[int], n: int) -> Iterator[tuple[int, int]]:
        """Stretches with template words no further apart than the template is long, however long they are."""
        start = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > n:
                yield places[start], places[i - 1] + 1
                start = i


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, coverage, first_word, last_word``: per document each template aligned to at least the threshold.

    Of a template's places in a text the best covered counts (ties: the first). Null and empty texts match nothing; rows
    are judged alone, so repeated rows give repeated findings. One pass, no shuffle; the templates are a parameter.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [(i, *x) for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()) if raw for x in scanner.scan(raw)]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
