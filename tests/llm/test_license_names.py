import pytest

from docloom.llm import licenses

NOTICES = [
    ("Released under the BSD License", "BSD-short"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under the MIT License", "MIT"),
    ("Released under the Foo License", None),
    ("Licensed under CC BY 4.0", "CC-BY-4.0-short"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0-short"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0-short"),
    ("Released under the Apache License 2.0", "Apache-2.0-short"),
    ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License", "GPL"),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0-text"),
]


@pytest.mark.parametrize(("text", "want"), NOTICES)
def test_notices_that_differ_in_the_name_only(text, want):
    found = licenses.Scanner(licenses.TEMPLATES).scan(f"some words before. {text}. Some words after.".encode())
    assert [x[0] for x in found] == ([want] if want else [])
    assert not want or found[0][2] >= 3 and found[0][1] >= 0.8


def test_every_template_is_found_in_its_own_text():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert any(x[:2] == (name, 1.0) for x in scanner.scan(text.encode())), name
    assert [x[0] for x in licenses.Scanner({"own": "a b c"}).scan(b"x a b c y")] == ["own"]
