"""License scans by patience alignment.

A text and a license template are aligned on the words that occur once in
each: they are anchors, the longest increasing subsequence of their places is
kept, and the gaps between anchors are aligned in the same way. Where a gap
has no unique words, its common beginning and end are matched. A template's
coverage is the share of its words that are matched.

A license may stand anywhere in a long text, and several times, so alignment
runs in windows of twice the template's length that start every half
template, and in windows of its length that start where a copy would whose
key word stands at some place of the text: a copy that another one follows at
once is so found wherever it begins. A window is only aligned if it could
reach the wanted coverage, that is, if enough of the template's words occur in it. Texts that lack all of a
template's key words, without which the coverage cannot be reached, are not
cut into words at all. Neither check can lose a match.

Nulls and edge cases: a null or empty text holds no license. Of matches of
one template that overlap, those are kept that do not and match the most words
together (then the fewest, the shortest, the first); matches of different
templates are reported side by side. Texts of any length are scanned whole.
Rows are independent, so repeated rows, ties of ids and empty tables need no
rule. Other columns are not read.

The fixed notices are much alike, so matches of different one-line notices
(``LINES``) that overlap are one, and so are those of longer texts: the best
coverage, then the most words, then the first and the order of the templates.
A notice listed in ``NAMES`` only matches with the words that name its license.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices

COVERAGE = 0.8
WORD = re.compile(r"\w+(?:[.'-]\w+)*")

#: Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT-line": "Licensed under the MIT License",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License",
    "ISC-line": "Licensed under the ISC License",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0",
    "EPL-2.0-line": "Licensed under the Eclipse Public License, Version 2.0",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0",
    "CC0-1.0-line": "Licensed under CC0 1.0",
    "CC0-1.0-text": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work""",
}
#: Words that a match must hold, of notices that otherwise fit other licenses' lines.
NAMES = {"GPL-2.0": "2", "LGPL-3.0": "lesser 3", "LGPL-2.1": "lesser 2.1", "AGPL-3.0": "affero", "MIT-line": "mit",
         "BSD-3-Clause-line": "bsd 3-clause", "BSD-2-Clause-line": "bsd 2-clause", "ISC-line": "isc", "MPL-2.0-line": "mozilla",
         "EPL-2.0-line": "eclipse", "GPL-2.0-header": "2", "CC0-1.0": "cc0", "CC0-1.0-line": "cc0"}

for _short, _long in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    for _version, _port in [("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")]:
        _name = f"CC-{_short}-{_version}"
        _forms = {_name: f"This work is licensed under a Creative Commons {_long} {_version} {_port} License",
                  f"{_name}-line": f"Licensed under CC {_short} {_version}", f"{_name}-id": f"Licensed under {_name}"}
        NAMES |= {n: w.lower() for n, w in zip(_forms, (_long, _short, _name)) if n not in TEMPLATES}
        TEMPLATES |= _forms

#: Notices of one line.
LINES = {n for n, t in TEMPLATES.items() if len(WORD.findall(t)) <= 20} - {"CC0-1.0-text"}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), increasing in both."""
    found: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and in_template[w] == 1}
        pairs = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        anchors = [pairs[i] for i in increasing([p for p, _ in pairs])]
        if not anchors:
            continue
        found += anchors
        i, j = a, c
        for p, q in [*anchors, (b, d)]:
            work.append((i, p, j, q))
            i, j = p + 1, q + 1
    return sorted(found)


def apart(matches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those (matched words, first, last + 1) that do not overlap and match the most words together."""
    order = sorted(matches, key=lambda m: (m[2], m[1], -m[0]))
    ends = [m[2] for m in order]
    totals, before = [(0, 0, 0)], []
    for i, (n, a, b) in enumerate(order):
        k = bisect_right(ends, a, 0, i)
        words, count, length = totals[k]
        total = (words + n, count - 1, length - (b - a))
        before.append(k if total > totals[-1] else -1)
        totals.append(max(total, totals[-1]))
    out, i = [], len(order)
    while i:
        if before[i - 1] < 0:
            i -= 1
        else:
            out.append(order[i - 1])
            i = before[i - 1]
    return out[::-1]


class Template:
    def __init__(self, name: str, text: str, coverage: float, must: str = ""):
        self.name, self.words = name, [w.lower() for w in WORD.findall(text)]
        self.must = set(must.split())
        self.count = Counter(self.words)
        self.need = max(1, -(-int(len(self.words) * coverage * 1000) // 1000))
        #: Longest words first until those without them are too few.
        self.keys: list[str] = []
        left = len(self.words)
        for w in sorted(self.count, key=lambda w: (-len(w), w)):
            if left < self.need:
                break
            self.keys.append(w)
            left -= self.count[w]
        #: Every match holds a key word, and every word that it must hold.
        sure = [min(self.must, key=self.count.__getitem__)] if self.must else self.keys
        self.places = {w: [j for j, x in enumerate(self.words) if x == w] for w in sure}

    def matches(self, words: list[str], known: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(matched words, first word, last word + 1) in windows that can reach the coverage."""
        size = len(self.words)
        seen = np.concatenate(([0], np.cumsum(known)))
        step = max(1, size // 2)
        starts = {p - j for p, w in enumerate(words) if w in self.places for j in self.places[w]}
        windows = chain(((lo, lo + 2 * size) for lo in range(0, max(1, len(words) - size // 2), step)), ((lo, lo + size) for lo in sorted(starts)))
        for lo, hi in windows:
            lo, hi = max(0, lo), min(len(words), hi)
            if seen[hi] - seen[lo] < self.need:
                continue
            window = words[lo:hi]
            here = Counter(w for w in window if w in self.count)
            if sum(min(n, self.count[w]) for w, n in here.items()) < self.need:
                continue
            pairs = align(window, self.words)
            if len(pairs) >= self.need and self.must <= {self.words[j] for _, j in pairs}:
                yield len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = [Template(n, t, coverage, NAMES.get(n, "") if TEMPLATES.get(n) == t else "") for n, t in templates.items()]
        self.fixed = {n: i for i, (n, t) in enumerate(templates.items()) if TEMPLATES.get(n) == t}

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) in code points, by start, end and name."""
        low = text.lower()
        able = [t for t in self.templates if all(k in low for k in t.must) and any(k in low for k in t.keys)]
        if not able:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in spans]
        count = Counter(words)
        out: list[tuple[int, int, str, float]] = []
        alike: dict[bool, list[tuple]] = {True: [], False: []}  # of one-line notices, of texts
        for t in able:
            if sum(min(n, count[w]) for w, n in t.count.items()) < t.need:
                continue
            known = np.fromiter((w in t.count for w in words), bool, len(words))
            for n, a, b in apart(set(t.matches(words, known))):
                found = (spans[a][0], spans[b - 1][1], t.name, n / len(t.words))
                if t.name in self.fixed:
                    alike[t.name in LINES].append((-found[3], -n, a, self.fixed[t.name], found))
                else:
                    out.append(found)
        for group in alike.values():
            kept: list[tuple[int, int, str, float]] = []  # by start
            for *_, found in sorted(group):
                k = bisect_left(kept, found[:1])
                if (k == 0 or kept[k - 1][1] <= found[0]) and (k == len(kept) or kept[k][0] >= found[1]):
                    kept.insert(k, found)
            out += kept
        return sorted(out)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses array<struct<start, end, name, coverage>>), one row for each document."""
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("coverage", pa.float64())]))
        for batch in slices(batches):
            found = [[dict(zip(("start", "end", "name", "coverage"), x)) for x in scanner.scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "licenses"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, licenses array<struct<start:bigint,end:bigint,name:string,coverage:double>>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read(spark, sf_dir, "documents"))
    best = F.element_at(F.array_sort("licenses", lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1)
                                     .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), 1)
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"], x["end"]))
    return found.withColumn("best", F.when(F.size("licenses") > 0, best)).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.col("best.name").alias("license"),
        F.round(F.col("best.coverage"), 6).alias("coverage"), F.array_join(spans, ",").alias("spans"))
