"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import carried, carried_columns, carried_fields, documents, rows, texts_of, with_text

COVERAGE = 0.8

# Public license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions "
        "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

# Short templates that differ from one another in a license's name only, and the words of each that make the name.
_CC = {"BY-ND": "NoDerivatives", "BY-NC": "NonCommercial", "BY-NC-SA": "NonCommercial-ShareAlike", "BY-NC-ND": "NonCommercial-NoDerivatives"}
TEMPLATES |= {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0-short": "Released under the Apache License 2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "BSD-short": "Released under the BSD License",
    "GPL": "This work is licensed under the GNU General Public License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0-version": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    **{f"CC-{k}-4.0-short": f"Licensed under CC {k} 4.0" for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{k}-4.0-text": f"This work is licensed under a Creative Commons Attribution-{v} 4.0 International License" for k, v in _CC.items()},
}
_FAMILIES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))


def _gnu_header(family: str, version: str) -> str:
    """The notice that the family's license asks programs to carry."""
    what = "library" if family == "LGPL" else "program"
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {_FAMILIES[family]} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_FAMILIES[family]} for more details."
    )


def _number(version: str) -> str:
    return version if "." in version else f"{version}.0"


_HEADERS = {f"{f}-{_number(v)}-header": (f, v) for f, v in _VERSIONS if (f, v) != ("GPL", "3")}
TEMPLATES |= {name: _gnu_header(*x) for name, x in _HEADERS.items()}
TEMPLATES |= {f"{f}-{_number(v)}-v": f"Licensed under the {_FAMILIES[f]} v{v}" for f, v in _VERSIONS}
_SPDX = (
    "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0"
    " GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {f"{i}-spdx": f"SPDX-License-Identifier: {i}" for i in _SPDX}

NAMES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3", "Apache-2.0": "Apache License, Version 2.0", "Apache-2.0-short": "Apache License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-short": "BSD License",
    "CC-BY-4.0": "Attribution 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0",
    "GPL": "GNU General Public License", "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "MIT": "MIT License", "MPL-2.0": "Mozilla Public License, v. 2.0", "MPL-2.0-version": "Mozilla Public License, version 2.0",
    **{f"CC-{k}-4.0-short": f"CC {k} 4.0" for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{k}-4.0-text": f"Attribution-{v} 4.0" for k, v in _CC.items()},
}
NAMES |= {f"{f}-{_number(v)}-v": f"{_FAMILIES[f]} v{v}" for f, v in _VERSIONS} | {f"{i}-spdx": f"SPDX-License-Identifier: {i}" for i in _SPDX}
#: Phrases that tell long templates apart: each must stand unbroken in the stretch that is aligned.
REQUIRED = {name: (f"terms of the {_FAMILIES[f]}", f"version {v} of the License") for name, (f, v) in _HEADERS.items()} | {"GPL-header": (f"terms of the {_FAMILIES['GPL']}", "version 3 of the License"), "Apache-2.0-header": ("Apache License, Version 2.0",)}
#: One of these in a sentence, up to two words before its notice or between that and the license's name, denies it.
DENIALS = frozenset((b"not", b"never", b"neither", b"nor", b"longer", b"unlike", b"cannot"))
#: Templates of fewer words must have their whole name in the text, word after word; without a name, all their words.
SHORT = 20

_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts words."""
    return data.lower().translate(_BREAKS).split()


_SENTENCE = re.compile(rb"[.!?;:]+(?=\s|$)|\n\s*\n")


def sentence_start(data: bytes, at: int) -> int:
    """The first word of the sentence that holds word `at`."""
    n = start = 0
    for piece in _SENTENCE.split(data):
        if n > at:
            break
        start, n = n, n + len(words_of(piece))
    return start


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience piles)."""
    tops, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = ends[pile - 1]
        if pile == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[pile], ends[pile] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both: words unique to both are anchors as far as a longest increasing
    subsequence keeps them; the gaps between anchors are aligned likewise, equal ends of a gap first."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        count_a, count_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: x for x, w in enumerate(b[k:m], k) if count_b[w] == 1}
        common = [(x, where[w]) for x, w in enumerate(a[i:j], i) if count_a[w] == 1 and w in where]
        anchors = [common[x] for x in longest_increasing([y for _, y in common])]
        out += anchors
        if anchors:
            for (x, y), (u, v) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
                todo.append((x + 1, u, y + 1, v))
    return sorted(out)


class Scanner:
    """Best coverage of templates by stretches of a text. A stretch is twice as long as the template and they overlap by
    half, so a notice as long as its template, with insertions up to its length, lies within one."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(text.encode())) for name, text in sorted(templates.items())]
        self.bags = [Counter(words) for _, words in self.templates]
        self.names = [words_of(NAMES.get(name, "").encode()) if len(words) < SHORT and templates[name] == TEMPLATES.get(name) else [] for name, words in self.templates]
        self.required = [[words_of(x.encode()) for x in REQUIRED.get(name, ())] if templates[name] == TEMPLATES.get(name) else [] for name, _ in self.templates]
        self.known = frozenset(w for _, words in self.templates for w in words)

    def stretches(self, words: list[bytes], bag: Counter, m: int) -> Iterator[tuple[int, int]]:
        """Those that hold enough of the template's words, counted with repeats, to reach the coverage asked for."""
        hits = [i for i, w in enumerate(words) if w in bag]
        need, last = self.coverage * m, -1
        for i in hits:
            for s in ((i // m - 1) * m, i // m * m):
                if s > last and s > -m:
                    last, start = s, max(0, s)
                    held = Counter(w for w in words[start : s + 2 * m] if w in bag)
                    if sum(min(n, bag[w]) for w, n in held.items()) >= need:
                        yield start, min(len(words), s + 2 * m)

    def named(self, data: bytes, words: list[bytes], template: list[bytes], name: list[bytes]) -> tuple[float, int, int, int]:
        """Best coverage, first and last word of a notice that has the name unbroken and is not denied, and where the name
        begins; the words before and
        after it are aligned with as many, doubled, of the text."""
        n, m, best = len(name), len(template), (0.0, 0, 0, 0)
        k = next(x for x in range(m) if template[x : x + n] == name)
        for at in [i for i, w in enumerate(words) if w == name[0] and words[i : i + n] == name]:
            start = max(0, at - 2 * k)
            head, tail = patience(words[start:at], template[:k]), patience(words[at + n : at + n + 2 * (m - n - k)], template[k + n :])
            first = start + head[0][0] if head else at
            if (share := (len(head) + n + len(tail)) / m) > best[0] and not (share >= self.coverage and self.denied(data, words, first, at)):
                best = (share, first, at + n + tail[-1][0] if tail else at + n - 1, at)
        return best

    def denied(self, data: bytes, words: list[bytes], first: int, end: int) -> bool:
        """Whether a denial stands in the sentence before word `end`, from two words before `first` on."""
        near = max(0, first - 2)
        if DENIALS.isdisjoint(words[near:end]):
            return False
        return not DENIALS.isdisjoint(words[max(near, sentence_start(data, first)) : end])

    def scan(self, data: bytes) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of the best stretch of each template that is covered enough: the
        first of those with the highest coverage. A short template counts only with its name, a long one with its
        required phrases, and none if its sentence denies it; a short one whose name lies within a longer name (GPL within
        GPL-3.0) or within the notice of a long template gives way."""
        words, out, named, whole = words_of(data), [], {}, []
        present = self.known.intersection(words)
        for (name, template), bag, own, phrases in zip(self.templates, self.bags, self.names, self.required, strict=True):
            m = len(template)
            coverage = self.coverage if own or m >= SHORT else 1.0
            if not m or sum(n for w, n in bag.items() if w in present) < coverage * m:
                continue
            best = (0.0, 0, 0)
            if own:
                *best, at = self.named(data, words, template, own)
            else:
                for start, stop in self.stretches(words, bag, m):
                    found = patience(words[start:stop], template)
                    if len(found) / m <= best[0]:
                        continue
                    first, last = start + found[0][0], start + found[-1][0]
                    if all(holds(words[first : last + 1], x) for x in phrases) and not self.denied(data, words, first, first):
                        best = (len(found) / m, first, last)
            if best[0] >= coverage:
                out.append((name, *best))
                if own:
                    named[name] = (at, at + len(own) - 1)
                elif m >= SHORT:
                    whole.append((best[1], best[2]))

        def within(name: str) -> bool:
            a, b = named[name]
            longer = [x for x in named.values() if x[1] - x[0] > b - a]
            return any(c <= a and b <= d for c, d in [*longer, *whole])

        return [x for x in out if x[0] not in named or not within(x[0])]


SCHEMA = T.StructType(
    [
        T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()),
    ]
)


def license_scan(docs: DataFrame, carry: list[str], templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """carry and, for every row's whole text: the license whose template is best covered (ties: the longer template, then
    the first by name), its coverage (share of the template's words aligned), the positions of the first and last aligned
    word, the number of templates covered enough and their names joined by commas. None: nulls, 0 and an empty string;
    so for null, empty and blank texts. Very long texts are scanned whole. Repeated rows come out repeated; no rows: no
    rows; columns of docs named as ours give way."""
    carry = carried(carry, SCHEMA.names)
    given = with_text(docs, carry)
    schema = T.StructType([*carried_fields(docs, carry), *SCHEMA.fields])
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        length = {name: len(words) for name, words in scanner.templates}
        for b in rows(batches):
            got = []
            for data in texts_of(b):
                found = scanner.scan(data)
                best = min(found, key=lambda x: (-x[1], -length[x[0]], x[0])) if found else (None,) * 4
                got.append((*best, len(found), ",".join(x[0] for x in found)))
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*carried_columns(b, carry), *cols], schema.names)

    return given.mapInArrow(run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), ["doc_id"])
