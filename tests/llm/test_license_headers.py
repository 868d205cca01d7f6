"""Headers that differ in family or version, identifiers, denials; named notices against a plain version."""

import random
import re

import pytest

from docloom.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES)
GPL = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {} for more details."
)


def names(text):
    return [x[0] for x in SCANNER.scan(text.encode())]


@pytest.mark.parametrize(
    ("family", "version", "want"),
    [("General Public License", "3", "GPL-header"), ("General Public License", "2", "GPL-2.0-header"), ("Affero General Public License", "3", "AGPL-3.0-header"), ("Lesser General Public License", "2.1", "LGPL-2.1-header"), ("Lesser General Public License", "3", "LGPL-3.0-header")],
)
def test_headers_of_families_and_versions(family, version, want):
    for text in (GPL.format(family, version, family), "/*\n * some file\n *\n * " + GPL.format(family, version, family).replace(". ", ".\n * ") + "\n */ int main"):
        assert names(text) == [want]
    assert names(GPL.format("Other Public License", version, family)) == []
    assert names(GPL.format(family, "9", family)) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: MIT", "MIT-spdx"), ("# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0-or-later-spdx"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-spdx"), ("SPDX-License-Identifier: MIT-0", "MIT-0-spdx"), ("SPDX-License-Identifier: Foo", None),
        ("Licensed under the GNU General Public License v3.", "GPL-3.0-v"), ("This work is licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1-v"), ("see the GNU General Public License v3", None),
        ("This file is not under the MIT License", None), ("No longer released under the MIT License.", None), ("It is released, not under the MIT License, but otherwise", None), ("Do not modify. Released under the MIT License", "MIT"), ("This is not mine\n\nReleased under the MIT License", "MIT"),
        ("Not released under the MIT License. Released under the MIT License!", "MIT"), ("It is never Licensed under CC BY 4.0", None),
    ],
)
def test_identifiers_and_denials(text, want):
    assert names(f"Some words before: {text}") == ([want] if want else [])


def plain_named(text, template, name):
    """Best share of a template's words by notices that hold the name: every place is tried, words around it counted by the
    alignment of whole neighbourhoods."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    t, n = (re.sub(r"[^\w]|_", " ", x.lower()).split() for x in (template, name))
    k = next(i for i in range(len(t)) if t[i : i + len(n)] == n)
    best = 0.0
    for at in range(len(words)):
        if words[at : at + len(n)] == n:
            head = licenses.patience(words[max(0, at - 2 * k) : at], t[:k])
            tail = licenses.patience(words[at + len(n) : at + len(n) + 2 * (len(t) - k - len(n))], t[k + len(n) :])
            best = max(best, (len(head) + len(n) + len(tail)) / len(t))
    return best


def test_named_notices_are_those_of_a_plain_search():
    rng, short = random.Random(5), [(n, t) for n, t in licenses.TEMPLATES.items() if n in licenses.NAMES]
    for _ in range(150):
        some = rng.sample(short, 3)
        words = " ".join(t for _, t in some).split() + ["foo", "bar", "License"] * rng.randrange(4)
        for _ in range(rng.randrange(4)):
            del words[rng.randrange(len(words))]
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words)), rng.choice(["the", "under", "word", "3"]))
        text = " ".join(words)
        found = {x[0]: x[1] for x in SCANNER.scan(text.encode())}
        want = {n: plain_named(text, t, licenses.NAMES[n]) for n, t in short}
        for n, share in found.items():
            assert n not in want or share == want[n] >= licenses.COVERAGE
        size = lambda n: len(licenses.words_of(licenses.NAMES[n].encode()))
        longest = max((size(n) for n, s in want.items() if s >= licenses.COVERAGE), default=0)
        for n, share in want.items():  # those that give way have their name within a longer one
            if share >= licenses.COVERAGE and size(n) == longest:
                assert n in found


def test_very_long_text_and_empty_table(spark):
    text = "word " * 3_500_000 + "\n\nReleased under the MIT License. " + "tail " * 500_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.license_scan(df, ["doc_id"]).first()
    assert row.license == "MIT" and row.first_word == 3_500_000
    assert licenses.license_scan(df.limit(0), ["doc_id", "text"]).collect() == []
