import html as stdlib_html
import random
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest

from docloom.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"
SCHEMA = "page_id long, url string, html string, n_chars int"


def brute_lcs(a, b):
    """Length of a longest common subsequence of two lists of lines."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def brute_place(url):
    try:
        u = urlsplit(url or "")
        return (u.hostname or "", u.path)
    except ValueError:
        return ("", url or "")


def brute_nearest(rows):
    """Of each row the lines of its nearest page, from the whole table at once. rows: page_id, url, html."""
    first = {}  # place -> the row that stands for it; texts of rows of one place and number are told apart by nothing here
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        first.setdefault(brute_place(r[1]), [t for _, t in html.blocks_of(r[2] or "")])
    places = sorted(first)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    out = []
    for r in rows:
        own = brute_place(r[1])
        at = places.index(own)
        kin = [places[i] for i in (at - 1, at + 1) if 0 <= i < len(places) and places[i][0] == own[0] != ""]
        best = max((common(k[1], own[1]) for k in kin), default=0)
        out.append(first[next(k for k in kin if common(k[1], own[1]) == best)] if kin else None)
    return out


def brute_texts(rows):
    """page_id, url, text; sorted."""
    out = []
    for r, nearest in zip(rows, brute_nearest(rows), strict=True):
        page = html.blocks_of(r[2] or "")
        shared = html.common_lines([t for _, t in page], nearest) if nearest else set()
        assert len(shared) == brute_lcs([t for _, t in page], nearest or [])
        marked = any(z == html.ARTICLE for z, _ in page)
        kept = [t for i, (z, t) in enumerate(page) if z == html.ARTICLE or z == html.OPEN and i not in shared and not (marked and nearest is None)]
        if not kept and not marked:
            kept = [t for z, t in page if z == html.OPEN]
        out.append((r[0], r[1], "\n".join(kept)))
    return sorted(out, key=str)


def extracted(spark, rows, part_bytes, partitions=4):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(partitions)
    got = html.extract(df, part_bytes).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=str)


def made_pages(seed=3, n=160):
    """Unmarked pages of few hosts: menus and footers of the host, stories of the page; paths that several pages have."""
    rng, out = random.Random(seed), []
    for i in range(n):
        host = rng.choice(["big.org"] * 4 + ["a.org", "b.org"])
        path = "/hot" if rng.random() < 0.3 else f"/{rng.choice('xyz')}/{rng.randrange(40)}"
        menu = [f"{host} menu {j}" for j in range(rng.randrange(1, 4))]
        story = [f"story {rng.randrange(60)}" for _ in range(rng.randrange(4))]
        lines = menu + story + [f"{host} imprint"]
        body = "".join(f"<p>{x}</p>" for x in lines)
        if rng.random() < 0.3:
            body = f"<p>{host} name</p><article><p>{' '.join(story)}</p></article><p>{host} imprint</p>"
        out.append((i, f"https://{host}{path}{'?q=' + str(i) if rng.random() < 0.3 else ''}", body))
    out += [out[5], out[5], (1000, None, None), (1001, "http://[bad", "<p>text</p>"), (1001, "http://[bad", "<p>text</p>"), (None, "https://a.org/none", "<p>x</p>"), (1002, "https://alone.org/", "<p>menu</p><p>story</p>")]
    out += [(1003, "https://long.org/1", "<p>same</p>" * 3000 + "<p>own one</p>" + "<p>tail</p>" * 2000), (1004, "https://long.org/2", "<p>same</p>" * 2990 + "<p>own two</p>" + "<p>tail</p>" * 2010)]
    return out


def test_texts_are_those_of_the_whole_table_however_it_is_cut(spark):
    rows = made_pages()
    want = brute_texts(rows)
    assert ("https://long.org/1", "own one") in {x[1:] for x in want} or any(x[2].endswith("own one") for x in want)
    for part_bytes, partitions in ((1 << 30, 1), (4000, 4), (300, 16), (1, 3)):
        assert extracted(spark, rows, part_bytes, partitions) == want
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """Every given page marks its article: the text is the article's; differencing alone already deletes some of the rest."""
    t = pq.read_table(PAGES)
    rows = list(zip(*(t[c].to_pylist() for c in ("page_id", "url", "html")), strict=True))
    got = {i: text for i, _, text in extracted(spark, rows, 1 << 16)}
    for i, _, h in rows:
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = (" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert got[i] == "\n".join(p for p in parts if p)
    count = Counter(x for (_, _, h), near in zip(rows, brute_nearest(rows), strict=True) for x in html.verdicts(html.blocks_of(h), near))
    assert count["shared"] > 0 and count["marked"] > 0 and count["beside"] == 0


def test_unmarked_pages_of_a_site(spark):
    """Pages without any mark: the same menu, sidebar and footer, other articles; nothing but differencing can tell."""
    rng = random.Random(8)
    chrome = ["<div>Home</div><div>About us</div>", "<div>Latest news</div><div>Contact us</div><div>All rights reserved</div>"]
    rows, want = [], {}
    for i in range(40):
        story = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, f"https://site.org/posts/{i:03d}", f"<body>{chrome[0]}<div>{'</div><div>'.join(story)}</div>{chrome[1]}</body>"))
        want[i] = "\n".join(story)
    assert {i: t for i, _, t in extracted(spark, rows, 500)} == want


def test_differencing():
    a, b = ([(0, t) for t in x.split()] for x in ("menu login story1 story2 foot", "menu login other foot more"))
    lines = lambda page: [t for _, t in page]
    assert html.main_text(a, lines(b)) == "story1\nstory2" and html.main_text(b, lines(a)) == "other\nmore" and html.main_text(a, None) == "menu\nlogin\nstory1\nstory2\nfoot"
    copy = [(0, "menu"), (2, "story"), (0, "stray")]
    assert html.main_text(copy, lines(copy)) == "story"  # a copy of the article next to it doesn't empty it
    assert html.main_text(a, lines(a)) == html.main_text(a, None)  # nor does a copy of an unmarked page
    assert html.verdicts([(1, "nav"), (1, "other"), (0, "x")], ["nav"]) == ["shared", "marked", "kept"]


def test_ties_go_to_the_path_before():
    before, after = (("h", "/a/1"), ["b"]), (("h", "/a/3"), ["a"])
    assert html.nearest_lines(("h", "/a/2"), before, after) == ["b"] and html.nearest_lines(("h", "/a/31"), before, after) == ["a"]
    assert html.nearest_lines(("g", "/a/2"), before, after) is None and html.nearest_lines(("", ""), (("", ""), ["x"]), None) is None


@pytest.mark.parametrize("cut", [[["a"], ["a"], ["a", "b"]], [["a", "b"], ["b"], ["b"], ["b", "c", "d", "e", "f"]], [["a"], ["b"], ["c"]], [["a", "b", "c"], ["d", "e"]]])
def test_neighbours_over_parts(cut):
    """Parts as lists of paths: what each asks for is the page that stands for the path before, of, and after its own."""
    ends = [(p, k, "h", paths[k]) for p, paths in enumerate(cut) for k in {0, min(1, len(paths) - 1), max(0, len(paths) - 2), len(paths) - 1}]
    all_paths, starts = sorted({x for paths in cut for x in paths}), {}
    for p, paths in enumerate(cut):
        for k, x in enumerate(paths):
            starts.setdefault(x, (p, k))
    want = set()
    for p, paths in enumerate(cut):
        at, end = all_paths.index(paths[0]), all_paths.index(paths[-1])
        want |= {(p, role, *starts[all_paths[i]]) for role, i in (("before", at - 1), ("own", at), ("after", end + 1)) if 0 <= i < len(all_paths)}
    assert set(html.neighbours(ends)) == want
