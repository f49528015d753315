"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template is cut into chunks of CHUNK words. Every text is covered by windows of WINDOW shingles, one every STRIDE, so
that some window holds a chunk whole; its MinHash agrees with the chunk's in each band with the probability of their
Jaccard similarity, at least the chunk's share of the window. bands() takes as many bands as make a miss of the shortest
template less likely than `miss`. Windows that retrieve one template side by side are one candidate region; in it, the
share of the template's shingles is counted exactly in every stretch of SLACK times the template's length, and each
occurrence, best first and none over another, is a match from `containment` on. Of matches of about one length that cover
each other by half, those of the greatest containment stay: a text of version 2 is not reported as version 3 too; templates
that tie there are all reported.

Words are runs of letters and digits, in lower case (ASCII); a shingle is two words. Null and empty texts and texts of
one word match nothing. A text of any length is scanned whole. Rows match each for itself, repeated or not. Other columns
are not used, whatever their names. An empty table gives no rows. The templates are a parameter and travel with the job:
their number and size are the caller's, not the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import joined, mix, pieces, span_hashes

# Short notices as people write them, then headers and texts as the licences word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}

#: Words in a chunk of a template, shingles in a window, shingles between windows, share of a template that is a match.
CHUNK, WINDOW, STRIDE, CONTAINMENT = 12, 16, 4, 0.8
#: Length of a stretch in which a template is counted, in lengths of the template; how alike in length two matches are compared.
SLACK, ALIKE = 1.25, 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bands(similarity: float, miss: float = 1e-4) -> int:
    """Bands of one row by which two sets of the similarity meet but for the chance of a miss."""
    return int(np.ceil(np.log(miss) / np.log(1 - similarity)))


def _shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each two words that follow each other in one text, and each text's first."""
    data, firsts = joined(text)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[data]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, firsts)
    word = span_hashes(_LOWER[data], starts, ends)
    two = mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(first))
    keep = doc[:-1] == doc[1:]
    return two[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 0))])


class Templates:
    def __init__(self, templates: Mapping[str, str], miss: float):
        self.names = sorted(templates)
        self.sets, self.spans, chunks, owner = [], [], [], []
        for k, name in enumerate(self.names):
            g, _ = _shingles(pa.array([templates[name]]))
            if not len(g):
                raise ValueError(f"template {name} has fewer than two words")
            self.sets.append(np.unique(g))
            self.spans.append(max(len(g), int(np.ceil(SLACK * len(g)))))
            for at in range(0, max(len(g) - CHUNK + 2, 1), CHUNK - 1):
                chunks.append(g[at : at + CHUNK - 1])
                owner.append(k)
        self.lengths = [len(x) for x in self.sets]
        self.n = bands(min(len(np.unique(x)) for x in chunks) / WINDOW, miss)
        self.odd = np.random.Generator(np.random.PCG64(17)).integers(0, 2**63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        owner = np.array(owner)
        self.keys, self.owners, self.marks = [], [], []
        for odd in self.odd:
            key = np.array([(x * odd).min() for x in chunks])
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.owners.append(owner[order])
            marks = np.zeros(1 << 16, bool)
            marks[key & np.uint64(0xFFFF)] = True
            self.marks.append(marks)

    def candidates(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, template, first shingle of the window), sorted, each once."""
        count = np.diff(first)
        blocks = -(-count // STRIDE)
        doc = np.repeat(np.arange(len(count)), blocks)
        start = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
        found = []
        if not len(start):
            return np.zeros((0, 3), np.int64)
        for odd, keys, owners, marks in zip(self.odd, self.keys, self.owners, self.marks, strict=True):
            least = np.minimum.reduceat(grams * odd, start)
            window = least.copy()
            for k in range(1, WINDOW // STRIDE):
                same = doc[k:] == doc[:-k]
                window[:-k][same] = np.minimum(window[:-k][same], least[k:][same])
            maybe = np.flatnonzero(marks[window & np.uint64(0xFFFF)])
            lo, hi = np.searchsorted(keys, window[maybe], "left"), np.searchsorted(keys, window[maybe], "right")
            for d in range(int((hi - lo).max()) if len(maybe) else 0):
                on = lo + d < hi
                found.append(np.stack([doc[maybe[on]], owners[lo[on] + d], start[maybe[on]]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, text: pa.Array, containment: float) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, words, containment) of every match."""
        grams, first = _shingles(text)
        rows, out, k = self.candidates(grams, first), [], 0
        while k < len(rows):
            d, t, lo = rows[k].tolist()
            hi = lo
            while k < len(rows) and rows[k, 0] == d and rows[k, 1] == t and rows[k, 2] <= hi + self.lengths[t] + WINDOW:
                hi, k = int(rows[k, 2]), k + 1
            lo, hi = max(int(first[d]), lo - self.lengths[t]), min(int(first[d + 1]), hi + WINDOW + self.lengths[t])
            near = grams[lo:hi]
            place = np.searchsorted(self.sets[t], near)
            at = np.flatnonzero(self.sets[t][np.minimum(place, len(self.sets[t]) - 1)] == near)
            need = int(np.ceil(containment * self.lengths[t] - 1e-9))
            if len(np.unique(place[at])) >= need:
                for a, b, n in occurrences(at, place[at], self.spans[t], max(need, 1)):
                    out.append((d, t, lo + a - int(first[d]), b - a + 2, n / self.lengths[t]))
        return best(out)


def occurrences(at: np.ndarray, kind: np.ndarray, span: int, need: int) -> list[tuple[int, int, int]]:
    """(first place, last place, kinds): stretches of at most `span` places with at least `need` different kinds, best first, none over another."""
    places, kinds = at.tolist(), kind.tolist()
    found, todo = [], [(0, len(places))]
    while todo:
        lo, hi = todo.pop()
        held, left, top = {}, lo, (0, 0, 0)
        for right in range(lo, hi):
            held[kinds[right]] = held.get(kinds[right], 0) + 1
            while places[right] - places[left] >= span or held[kinds[left]] > 1:  # too wide, or its first place is not needed
                held[kinds[left]] -= 1
                if not held[kinds[left]]:
                    del held[kinds[left]]
                left += 1
            if len(held) > top[0]:
                top = len(held), left, right
        n, a, b = top
        if n >= need:
            while b + 1 < hi and places[b + 1] == places[b] + 1 and places[b + 1] - places[a] < span:  # shingles that recur in the template
                b += 1
            while a > lo and places[a - 1] == places[a] - 1 and places[b] - places[a - 1] < span:
                a -= 1
            found.append((places[a], places[b], n))
            todo += [(lo, a), (b + 1, hi)]
    return sorted(found)


def best(matches: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Matches without those that one of about their length and of greater containment covers by half."""
    out, longest = [], max([m[3] for m in matches], default=0)
    matches = sorted(matches, key=lambda m: (m[0], m[2], m[1]))
    for k, m in enumerate(matches):
        beaten = False
        for step in (-1, 1):
            n = k + step
            while 0 <= n < len(matches) and matches[n][0] == m[0] and abs(matches[n][2] - m[2]) <= longest:
                o = matches[n]
                both = min(m[2] + m[3], o[2] + o[3]) - max(m[2], o[2])
                beaten |= o[4] > m[4] and min(m[3], o[3]) >= ALIKE * max(m[3], o[3]) and 2 * both >= min(m[3], o[3])
                n += step
        if not beaten:
            out.append(m)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, miss: float = 1e-4) -> DataFrame:
    """Rows (doc_id, license, first_word, n_words, containment): the matches in docs (doc_id, text), whole texts."""
    kinds = Templates(templates, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = kinds.matches(batch.column("text"), containment)
            d, t, at, n, share = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(d.astype(np.int64))), pa.array([kinds.names[k] for k in t.tolist()], pa.string()), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(share.astype(np.float64))],
                ["doc_id", "license", "first_word", "n_words", "containment"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, first_word long, n_words long, containment double")
