"""Main text of web pages by nearest-URL page differencing, with the pages' own marks of what is content."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate, groupby
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, rows, table

# HTML's element names by their part in a page, and usual names of page parts that are no content.
RAW = "script|style|noscript|template|textarea|title|svg|math|select|iframe|object|canvas|audio|video"
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside form dialog menu button search fieldset".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal "
    "nav navbar navigation newsletter notice notices popup promo promotion related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "cmt cmts respond response responses teaser teasers recommendations".split()
)
#: Of these names those that say that an article element is no main text; others may name the layout around it.
NO_ARTICLE = CHROME_NAMES & frozenset("ad ads advert adverts advertisement cmt cmts comment comments commentlist promo promotion recommendations related reply replies respond response responses sponsor sponsored teaser teasers".split())
CHROME_ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert menu menubar".split())

MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
OPEN, CHROMED, ARTICLE = 0, 1, 2


def zone_of(name: str, attrs: str) -> int | None:
    """What an element makes of what it holds; None: nothing new."""
    if name in CHROME:
        return CHROMED
    if attrs:
        for key, *values in NAMES.findall(attrs):
            value = "".join(values).lower()
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return CHROMED
            telling = CHROME_NAMES if name not in ("html", "body", *CONTENT) else NO_ARTICLE if name == "article" else frozenset()
            if key == "role" and value in CHROME_ROLES or key in ("class", "id") and not telling.isdisjoint(re.split(r"[\s_-]+", value)) or key == "itemprop" and "comment" in value.split():
                return CHROMED
            if key == "role" and value in ("main", "article"):
                return ARTICLE
    return ARTICLE if name in CONTENT else None


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order: text between block boundaries, character references decoded, white
    space runs made one space, trimmed; empty blocks left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements that can bear a zone, and the zone within
    zone, pieces, at = OPEN, [], 0

    def flush():
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.append((zone, text))
            pieces.clear()

    for m in MARK.finditer(html):
        if m.start() > at:
            pieces.append(unescape(html[at : m.start()]))
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
        if name not in BLOCKS and name != "span" and name != "a":
            continue
        if name in BLOCKS:
            flush()
        if m["end"]:
            if any(x == name for x, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not m["attrs"].endswith("/"):
            if name in BLOCKS:
                while stack and stack[-1][0] == "p" or stack and name == "li" == stack[-1][0]:  # a block ends an open paragraph
                    stack.pop()
            now = stack[-1][1] if stack else OPEN
            own = zone_of(name, m["attrs"])
            if own is None and name == "header" and now != ARTICLE or name == "article" and any(x == "article" for x, _ in stack):
                own = CHROMED  # articles within articles are what readers say, by the standard's own example
            if now == CHROMED or own is None:
                own = now
            if name in BLOCKS or own != now:
                stack.append((name, own))
        new = stack[-1][1] if stack else OPEN
        if new != zone:
            flush()
            zone = new
    pieces.append(unescape(html[at:]))
    flush()
    return out


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """The rows of the table of common subsequence lengths as bit sets, a bit for each line of b: a cleared bit says that
    the length grows at this line. First the row before any line of a."""
    where: dict[str, int] = defaultdict(int)
    for y, line in enumerate(b):
        where[line] |= 1 << y
    row = full = (1 << len(b)) - 1
    yield row
    for line in a:
        match = row & where.get(line, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def _lengths(row: int, n: int) -> list[int]:
    """A row's length for every number of lines of b."""
    bits = f"{row:0{n}b}"[::-1] if n else ""
    return [0, *accumulate(int(x == "0") for x in bits)]


def common_lines(a: list[str], b: list[str], most: int = 1 << 27) -> set[int]:
    """Positions in a of the lines of a longest common subsequence of a and b. Equal ends are taken first; a table of over
    `most` bits is halved first, at the split of b that loses nothing."""
    shared, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            shared.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            shared.add(j)
        n = m - k
        if i == j or not n:
            continue
        if (j - i) * n > most and j - i > 1:
            half = (i + j) // 2
            *_, first = _rows(a[i:half], b[k:m])
            *_, last = _rows(a[half:j][::-1], b[k:m][::-1])
            both = [x + y for x, y in zip(_lengths(first, n), _lengths(last, n)[::-1], strict=True)]
            cut = k + both.index(max(both))
            todo += [(i, half, k, cut), (half, j, cut, m)]
            continue
        rows = [*_rows(a[i:j], b[k:m])]
        length = lambda x, y: y - (rows[x] & ((1 << y) - 1)).bit_count()  # noqa: B023, E731
        x, y = j - i, n
        while x and y:
            if a[i + x - 1] == b[k + y - 1]:
                x, y = x - 1, y - 1
                shared.add(i + x)
            elif length(x - 1, y) >= length(x, y - 1):
                x -= 1
            else:
                y -= 1
    return shared


def verdicts(page: list[tuple[int, str]], nearest: list[str] | None) -> list[str]:
    """For each line of a page what becomes of it: "shared" (an alignment with the nearest page's lines finds it there too:
    deleted), "marked" (the page marks it as a menu or the like: deleted), "beside" (unmarked, beside a marked article, and no
    nearest page to tell: deleted) or "kept". Two exceptions keep shared lines: those of an article that the page marks (a
    neighbour may hold a copy of it), and the unmarked lines of a page that differencing would leave empty (the neighbour
    is a copy of it)."""
    shared = common_lines([t for _, t in page], nearest) if nearest else set()
    has_article = any(z == ARTICLE for z, _ in page)
    out = ["kept" if z == ARTICLE else "shared" if i in shared else "marked" if z == CHROMED else "beside" if has_article and nearest is None else "kept" for i, (z, _) in enumerate(page)]
    if not has_article and "kept" not in out:
        out = ["kept" if z == OPEN else x for (z, _), x in zip(page, out, strict=True)]
    return out


def main_text(page: list[tuple[int, str]], nearest: list[str] | None) -> str:
    return "\n".join(t for (_, t), x in zip(page, verdicts(page, nearest), strict=True) if x == "kept")


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty for null, the whole as path where it can't be parsed."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or "", u.path)
    except ValueError:
        return "", url or ""


def kinship(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    return len(commonprefix((a, b)))


Place = tuple[str, str]  # host and path


def nearest_lines(place: Place, before: tuple[Place, list[str]] | None, after: tuple[Place, list[str]] | None) -> list[str] | None:
    """Of the pages at the paths before and after, if of the same host, the lines of the one with the longer common start
    of the path (ties: the one before)."""
    kin = [x for x in (before, after) if x is not None and x[0][0] == place[0] != ""]
    return max(kin, key=lambda x: kinship(x[0][1], place[1]))[1] if kin else None


def order_of(page_id: int | None, url: str | None, digest: int) -> tuple:
    """Sorts pages by host, path, number (null first), URL and text."""
    return (*address(url), page_id is not None, page_id or 0, url or "", digest)


#: Bytes of html that make one part of the sorted pages; keys for each part that a sample brings to the driver.
PART_BYTES, KEYS = 1 << 20, 8


def bounds_of(pages: DataFrame, part_bytes: int) -> list[tuple]:
    """Where parts of the sorted pages begin, from a sample that hashes choose."""
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    parts = -(-(size or 0) // part_bytes)
    if parts < 2:
        return []
    drawn = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, n // (KEYS * parts)))) == 0)
    keys = sorted(order_of(*r) for r in drawn.select("page_id", "url", F.xxhash64("html")).collect())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def by_path(part: pa.Table) -> list[tuple[Place, list[int]]]:
    """The places of a part's pages in order, each with its rows."""
    keys = [order_of(*r.values()) for r in part.select(["page_id", "url", "digest"]).to_pylist()]
    return [(place, list(own)) for place, own in groupby(sorted(range(len(keys)), key=keys.__getitem__), key=lambda i: keys[i][:2])]


def ends_of_part(part: pa.Table) -> list[tuple]:
    """p, k, host, path and lines of the first page of a part's first two and last two paths."""
    found, p = by_path(part), part["p"][0].as_py()
    return [(p, k, *found[k][0], part["lines"][found[k][1][0]].as_py()) for k in sorted({0, min(1, len(found) - 1), max(0, len(found) - 2), len(found) - 1})]


def neighbours(ends: list[tuple]) -> list[tuple]:
    """(p, role, p and k of an end) for each part: whose page stands for the path before its first one, for its first one
    itself (an earlier part may begin it, and a path can fill several parts) and for the path after its last one. ends: p,
    k, host, path."""
    runs, first, last = [], {}, {}
    for p, k, *place in sorted(ends):
        if not runs or runs[-1][0] != place:
            runs.append((place, p, k))
        first.setdefault(p, len(runs) - 1)
        last[p] = len(runs) - 1
    asked = [(p, role, i) for p in first for role, i in (("before", first[p] - 1), ("own", first[p]), ("after", last[p] + 1))]
    return [(p, role, *runs[i][1:]) for p, role, i in asked if 0 <= i < len(runs)]


def texts_of_part(part: pa.Table, sides: dict[str, tuple[Place, list[str]]]) -> Iterator[tuple[int | None, str | None, str]]:
    """page_id, url and text of every page of a part. A path is stood for by its first page; pages of one path, the same page asked
    for in other ways, are not held against each other."""
    found, zones, lines = by_path(part), part["zones"].to_pylist(), part["lines"].to_pylist()
    ids, urls = part["page_id"].to_pylist(), part["url"].to_pylist()
    stands = [sides.get("before"), *((place, lines[own[0]]) for place, own in found), sides.get("after")]
    stands[1] = sides.get("own", stands[1])
    for i, (place, own) in enumerate(found):
        nearest = nearest_lines(place, stands[i], stands[i + 2])
        for r in own:
            yield ids[r], urls[r], main_text(list(zip(zones[r], lines[r], strict=True)), nearest)


def extract(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Pages are sorted by host and path and cut into parts of about part_bytes, wherever that falls, so a host or a path of
    any size is spread over tasks; parts tell each other the lines at their ends, so the cut changes no text. A page's
    nearest is, of the paths beside its own and of its host, the one with the longer common start (ties: the one before);
    a path's first page stands for it. A page alone of its host has none. Null html: empty text. Null url: no host, no
    nearest page. Repeated rows come out repeated, like every page of one path; very long pages are aligned whole; no rows:
    no rows; further columns are ignored. What one task gets of all parts is a host and path for each end.
    """
    bounded(pages.sparkSession)
    bounds = bounds_of(pages, part_bytes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 256):
            out = []
            for page_id, url, html, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = blocks_of(html or "")
                out.append((bisect_right(bounds, order_of(page_id, url, digest)), page_id, url, *address(url), digest, [z for z, _ in found], [t for _, t in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), parsed, strict=True)], schema=parsed)

    parsed = pa.schema([("p", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("zones", pa.list_(pa.int32())), ("lines", pa.list_(pa.string()))])
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.xxhash64("html").alias("digest"))
    dealt = given.mapInArrow(parse, "p int, page_id long, url string, host string, path string, digest long, zones array<int>, lines array<string>")
    kinds = {"p": pa.int32(), "k": pa.int32(), "host": pa.string(), "path": pa.string(), "lines": pa.list_(pa.string())}

    def tell(part: pa.Table) -> pa.Table:
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), zip(*ends_of_part(part), strict=True), strict=True)})

    def pair(light: pa.Table) -> pa.Table:
        found = neighbours([tuple(r.values()) for r in light.select(["p", "k", "host", "path"]).to_pylist()])
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("p", pa.int32()), ("role", pa.string()), ("source", pa.int32()), ("k", pa.int32())))})

    def run(part: pa.Table, sides: pa.Table) -> pa.Table:
        known = {r["role"]: ((r["host"], r["path"]), r["lines"]) for r in sides.to_pylist()}
        done = [(*r, len(r[2])) for r in texts_of_part(part, known)] if part.num_rows else []
        return pa.table({n: pa.array([x[i] for x in done], t) for i, (n, t) in enumerate((("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())))})

    ends = dealt.groupBy("p").applyInArrow(tell, "p int, k int, host string, path string, lines array<string>")
    wanted = ends.select("p", "k", "host", "path").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(pair, "p int, role string, source int, k int")
    sides = wanted.join(ends.withColumnRenamed("p", "source"), ["source", "k"]).select("p", "role", "host", "path", "lines")
    return dealt.groupBy("p").cogroup(sides.groupBy("p")).applyInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
