"""License scans by patience alignment.

Text and template are aligned on the words that occur once in each: of these anchors the longest increasing subsequence is taken,
and the gaps between are aligned in the same way; a gap without anchors by a longest common subsequence. The share of the template's words that are aligned is its coverage.
A document that lacks too many of a template's words is left out first: their number bounds the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.words import small_batches

#: The wording of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Share of a template's words that has to be aligned.
COVERAGE = 0.8
#: Words too common to start a region, in the notices and in prose.
COMMON = frozenset(b"a an and any as at be by for from in is it of on or that the this to under was with you".split())
_WORD = re.compile(rb"[a-z0-9]+")


def tokens(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, at, back = [], [], []
    for k, x in enumerate(places):
        pile = bisect_left(tops, x)
        if pile == len(tops):
            tops.append(x)
            at.append(k)
        else:
            tops[pile], at[pile] = x, k
        back.append(at[pile - 1] if pile else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _common(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    rows = [[0] * (len(template) + 1)]
    for x in reversed(text):
        last, new = rows[-1], [0] * (len(template) + 1)
        for k in range(len(template) - 1, -1, -1):
            new[k] = last[k + 1] + 1 if x == template[k] else max(last[k], new[k + 1])
        rows.append(new)
    rows.reverse()
    out, i, k = [], 0, 0
    while i < len(text) and k < len(template):
        if text[i] == template[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        elif rows[i + 1][k] >= rows[i][k + 1]:
            i += 1
        else:
            k += 1
    return out


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if ours[w] == 1}
        shared = [(place[w], k) for k, w in enumerate(template[c:d], c) if theirs[w] == 1 and w in place]
        anchors = [shared[k] for k in _rising([x for x, _ in shared])]
        out += anchors
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]) if anchors else ():
            todo.append((p + 1, r, q + 1, s))
        if not anchors and ours.keys() & theirs.keys():
            out += [(a + i, c + k) for i, k in _common(text[a:b], template[c:d])]
    return sorted(out)


def _reach(words: list[bytes], places: range, template: list[bytes], need: float) -> int | None:
    """The first of ``places`` by which ``need`` words of the template have come in order (a common subsequence, in bits)."""
    masks: dict[bytes, int] = {}
    for k, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << k
    full = row = (1 << len(template)) - 1
    for k in places:
        if m := masks.get(words[k], 0):
            row = ((row + (row & m)) | (row & ~m)) & full
            if len(template) - row.bit_count() >= need:
                return k
    return None


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: tokens(text) for name, text in templates.items()}
        self.vocabulary = frozenset(w for t in self.templates.values() for w in t)

    def _regions(self, places: list[int], n: int, size: int):
        """Runs of places no further apart than the template is long, with as many words before and after."""
        a = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] - places[k - 1] > n:
                yield max(0, places[a] - n), min(size, places[k - 1] + n + 1)
                a = k

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """``(template, coverage, first byte, byte after the last)`` of every stretch that covers a template enough."""
        if not text:
            return []
        lower = text.lower()
        words = _WORD.findall(lower)
        here = self.vocabulary.intersection(words)
        if not here - COMMON:
            return []
        could = [(name, t) for name, t in self.templates.items() if sum(w in here for w in t) >= self.coverage * len(t)]
        if not could:
            return []
        spans = [m.span() for m in _WORD.finditer(lower)]
        out = []
        for name, template in could:
            n, rare = len(template), set(template) - COMMON
            places = [k for k, w in enumerate(words) if w in rare]
            for a, b in self._regions(places, n, len(words)):
                out += [(name, *x, spans[y][0], spans[z - 1][1]) for x, y, z in self._region(words, a, b, template)]
        return out

    def _region(self, words: list[bytes], a: int, b: int, template: list[bytes]):
        """The whole region if its anchors cover the template; else windows, so repeats of a notice do not hide each other.

        Between what these find, windows grow until they hold enough words of the template in order.
        """
        n = len(template)
        need = self.coverage * n
        at = done = a
        for lo, hi in [(a, b)] if b - a <= 4 * n and self._once(words[a:b], template) else self._windows(words, a, b, template, need):
            if lo < at:
                continue
            pairs = [(lo + i, k) for i, k in align(words[lo:hi], template)]
            if len(pairs) >= need:
                pairs = self._settled(words, at, b, template, pairs, need)
                first, last = pairs[0][0], pairs[-1][0] + 1
                yield from self._stretched(words, done, first, template)
                yield (len(pairs) / n,), first, last
                at = done = last
        yield from self._stretched(words, done, b, template)

    @staticmethod
    def _windows(words: list[bytes], a: int, b: int, template: list[bytes], need: float):
        """Windows somewhat longer than the template with enough of its words, whatever their order; their counts slide along."""
        n = len(template)
        size, theirs = n + max(2, n // 4), Counter(template)
        ours: dict[bytes, int] = dict.fromkeys(theirs, 0)
        common = end = 0
        end = a
        for start in range(a, b):
            while end < min(b, start + size):
                w = words[end]
                if w in ours:
                    common += ours[w] < theirs[w]
                    ours[w] += 1
                end += 1
            if common >= need:
                yield start, end
            w = words[start]
            if w in ours:
                ours[w] -= 1
                common -= ours[w] < theirs[w]

    def _settled(self, words: list[bytes], a: int, b: int, template: list[bytes], pairs: list[tuple[int, int]], need: float):
        """The pairs trimmed, and aligned again with room for what the template has before and after them, while that finds more."""
        n = len(template)
        pad = max(2, n // 4)
        pairs = self._trimmed(pairs, need, n)
        while len(pairs) < n:
            lo, hi = max(a, pairs[0][0] - pairs[0][1] - pad), min(b, pairs[-1][0] + n - pairs[-1][1] + pad)
            more = self._trimmed([(lo + i, k) for i, k in align(words[lo:hi], template)], need, n)
            if len(more) <= len(pairs):
                break
            pairs = more
        return pairs

    @staticmethod
    def _trimmed(pairs: list[tuple[int, int]], need: float, n: int) -> list[tuple[int, int]]:
        """The pairs without those at an end that a gap parts from the others, as long as the others cover the template enough."""
        gap = max(2, n // 4)
        while len(pairs) > need:
            cuts = [k for k in range(1, len(pairs)) if pairs[k][0] - pairs[k - 1][0] > gap]
            ends = [x for x in ((cuts[0], pairs[cuts[0] :]), (len(pairs) - cuts[-1], pairs[: cuts[-1]])) if len(x[1]) >= need] if cuts else []
            if not ends:
                break
            pairs = min(ends, key=lambda x: x[0])[1]
        return pairs

    def _stretched(self, words: list[bytes], a: int, b: int, template: list[bytes]):
        """Stretches of any length that cover the template: each ends as early and then starts as late as it can."""
        n = len(template)
        need, pad = self.coverage * n, max(2, n // 4)
        while (end := _reach(words, range(a, b), template, need)) is not None:
            start = _reach(words, range(end, a - 1, -1), template[::-1], need)
            lo, hi = max(a, start - pad), min(b, end + 1 + pad)
            pairs = align(words[lo:hi], template)
            if len(pairs) < need:  # an anchor that does not belong there parts the others
                pairs = _common(words[lo:hi], template)
            pairs = self._settled(words, a, b, template, [(lo + i, k) for i, k in pairs], need)
            first, last = pairs[0][0], pairs[-1][0] + 1
            yield (len(pairs) / n,), first, last
            a = max(last, end + 1)

    @staticmethod
    def _once(words: list[bytes], template: list[bytes]) -> bool:
        """Whether the rare words of the template are in the region no oftener than in the template."""
        ours, theirs = Counter(words), Counter(template)
        return all(ours[w] <= n for w, n in theirs.items() if w not in COMMON)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each stretch of a text that covers a template: ``doc_id, license, coverage, first_byte, end_byte`` (of the text in UTF-8).

    Stretches of one template do not overlap, and of overlapping ones that which begins first is given; templates are sought each
    on its own, so a notice that is part of another is found as both. Null and empty texts give none; repeated rows give theirs
    each; texts are read whole, however long; other columns are not read; an empty table gives no rows. The templates are a
    parameter of the driver's and bounded by it. No shuffle.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, coverage)
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        for batch in batches:
            found = [(k, *x) for k, text in enumerate(batch.column(1).to_pylist()) for x in scanner.scan(text)]
            ids = batch.column(0).cast(kind).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())], ["doc_id", "license", "coverage", "first_byte", "end_byte"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, license string, coverage double, first_byte long, end_byte long"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
