"""License scans: winnowed fingerprints of templates find candidates, banded alignment measures them.

Templates and documents are sequences of words (letters and digits, lower-cased).  Of every ``WINDOW`` neighbouring hashes of
``GRAM`` words the least is kept (winnowing), so any shared run of ``GRAM + WINDOW - 1`` words shares a fingerprint.  An
inverted index from fingerprints to places in templates gives candidate diagonals, and a local alignment within a band
around them reports the matched words, their share of the template and the span in the text.  Hits inside a reported span are
done; around all others what is left of the band is aligned again.

The index is sent to every task in blocks of at most ``MOST_WORDS`` words of templates; more templates take more blocks, each a further
step over the documents, so any number gives all results.

Defined results: null and empty texts have no license, an empty table gives no rows; a template that occurs several times in a document
gives several rows, repeated rows of documents each their own; templates with the same words each report; of alignments with the same score the
one that ends first counts.  Other columns of the documents play no part, whatever their names.  A text is kept whole by its task, however
long.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm import textops as X

GRAM, WINDOW, BAND = 3, 3, 12
MOST_WORDS = 500_000
LEAST_COVERAGE, LEAST_WORDS = 0.8, 4
#: A long template also counts if so many of its words are found in order.
LONG_MATCH = 20
MATCH, MISMATCH, GAP = 2, -1, -1

#: Notices and opening paragraphs of public licenses (fixed values).
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def winnow(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all documents and the words at which they start; short documents keep all their grams."""
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, X.U64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for k in range(1, GRAM):
        g = X.mix(g * X.U64(3) + h[k : k + n])
    doc = X.doc_of(at)
    g[doc[:n] != doc[GRAM - 1 :]] = X.U64(2**64 - 1)  # across documents: never a least hash of a window that has others
    keep = np.zeros(n, bool)
    m = n - WINDOW + 1
    if m > 0:
        stack = np.stack([g[k : k + m] for k in range(WINDOW)])
        keep[np.arange(m) + stack.argmin(0)] = True
    inside = doc[:n] == doc[GRAM - 1 :]
    few = np.diff(at) < GRAM + WINDOW - 1
    keep |= few[doc[:n]]
    keep &= inside
    pos = np.flatnonzero(keep)
    return g[pos], pos


def align(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """Local alignment of template ``a`` with text ``b`` where a[i] stands near b[i + shift].

    Returns matched words, first and last + 1 word in ``b``, and the score.  Cells outside the band aren't reached.
    """
    width = 2 * BAND + 1
    cols = shift - BAND + np.arange(width)
    previous = [(0, 0, -1)] * (width + 1)  # score, matches, begin
    best = (0, 0, -1, -1)
    nb = len(b)
    for i in range(len(a)):
        row: list[tuple[int, int, int]] = []
        x = a[i]
        for c in range(width):
            j = int(cols[c]) + i
            if j < 0 or j >= nb:
                row.append((0, 0, -1))
                continue
            score, matches, begin = previous[c]
            if b[j] == x:
                cell = (score + MATCH, matches + 1, begin if score > 0 else j)
            else:
                cell = (score + MISMATCH, matches, begin)
            if c + 1 < width and previous[c + 1][0] + GAP > cell[0]:
                cell = (previous[c + 1][0] + GAP, *previous[c + 1][1:])
            if row and row[-1][0] + GAP > cell[0]:
                cell = (row[-1][0] + GAP, *row[-1][1:])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            elif cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
        row.append((0, 0, -1))
        previous = row
    return best[1], best[2], best[3], best[0]


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, off = X.string_bytes(X.string_array([templates[k] for k in self.names]))
        self.words, _, _, self.at = X.plain_words(data, off)
        # all places of the winnowed fingerprints
        n = len(self.words) - GRAM + 1
        g = self.words[:n].copy()
        for k in range(1, GRAM):
            g = X.mix(g * X.U64(3) + self.words[k : k + n])
        doc = X.doc_of(self.at)
        winnowed, pos = winnow(self.words, self.at)
        ok = np.flatnonzero((doc[:n] == doc[GRAM - 1 :]) & np.isin(g, winnowed))
        order = np.argsort(g[ok], kind="stable")
        self.keys, self.pos = g[ok][order], ok[order]
        self.owner = doc[self.pos]

    @staticmethod
    def _free(spans: list[tuple[int, int]], place: int, lo: int, hi: int) -> tuple[int, int]:
        """The words from ``lo`` to ``hi`` around a hit that aren't in a span; none if the whole hit is in spans."""
        for word in range(place, place + GRAM):
            k = bisect.bisect_right(spans, word, key=lambda x: x[0])
            before = spans[k - 1][1] if k else lo
            if before <= word:
                return max(lo, before), min(hi, spans[k][0] if k < len(spans) else hi)
        return place, place

    def scan(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, template, matched words, first word, last word + 1), words counted over all documents."""
        keys, pos = winnow(h, at)
        a, b = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        on = np.flatnonzero(b > a)
        j = X.ragged(a[on], (b - a)[on])
        place = np.repeat(pos[on], (b - a)[on])
        doc = np.searchsorted(at, place, side="right") - 1
        shift = place - (self.pos[j] - self.at[self.owner[j]])
        rows = np.unique(np.column_stack([doc, self.owner[j], shift, place]), axis=0)
        out: list[tuple[int, int, int, int, int]] = []
        begins = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[: len(rows)])
        group, spans = None, []
        for a, b in zip(begins, [*begins[1:], len(rows)]):
            d, t, s = rows[a, :3].tolist()
            if group != (d, t):
                group, spans = (d, t), []  # the reported spans of this template in this document, in order
            template = self.words[self.at[t] : self.at[t + 1]]
            lo, hi = max(int(at[d]), s - BAND), min(int(at[d + 1]), s + len(template) + BAND)
            # what is left of the band around hits that no span has
            ahead = rows[a:b, 3].tolist()
            while ahead:
                place = ahead[-1]
                first, last = self._free(spans, place, lo, hi)
                if last - first < LEAST_WORDS:
                    ahead.pop()
                    continue
                matched, begin, end, _ = align(template.tolist(), h[first:last].tolist(), s - first)
                if matched >= max(LEAST_WORDS, LEAST_COVERAGE * len(template)) or matched >= LONG_MATCH:
                    out.append((d, t, matched, first + begin, first + end))
                    bisect.insort(spans, (first + begin, first + end))
                else:  # nor has any other hit in the same place of the text
                    ahead = [x for x in ahead if x != place and self._free(spans, x, lo, hi) != (first, last)]
        return sorted(set(out))


def blocks(templates: dict[str, str], most: int) -> list[dict[str, str]]:
    """The templates in parts of at most ``most`` words (a longer template is a part of its own)."""
    out, size = [{}], 0
    for name in sorted(templates):
        words = len(X.plain_words(*X.string_bytes(X.string_array([templates[name]])))[0])
        if out[-1] and size + words > most:
            out.append({})
            size = 0
        out[-1][name] = templates[name]
        size += words
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license found: its name, matched words, share of the template, and the span in bytes."""
    indexes = [Index(block) for block in blocks(TEMPLATES if templates is None else templates, MOST_WORDS)]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("license", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run_with(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in X.slices(batches, text):
                data, off = X.string_bytes(batch.column(text))
                h, s, e, at = X.plain_words(data, off)
                found = index.scan(h, at)
                if found:
                    columns = [batch.column(key).take(pa.array([d for d, *_ in found])), pa.array([index.names[t] for _, t, *_ in found]), pa.array([m for _, _, m, *_ in found]), pa.array([m / int(index.at[t + 1] - index.at[t]) for _, t, m, *_ in found]), pa.array([int(s[f] - off[d]) for d, _, _, f, _ in found]), pa.array([int(e[l - 1] - off[d]) for d, _, _, _, l in found])]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

        return run

    return reduce(DataFrame.unionAll, [docs.select(key, text).transform(X.arrow, run_with(index), schema) for index in indexes])
