"""Web pages: main content, Markdown, links and a breadth-first crawl over stored pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

MOST_PAGES = 25
_SKIP, _VOID = {"script", "style", "noscript", "template"}, {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {
    "p", "div", "section", "article", "main", "ul", "ol", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "header", "footer", "nav", "aside", "body", "dl", "dt", "dd", "figure", "figcaption", "form", "fieldset", "details",
    "summary", "address",
}
#: Text that would read as a mark of Markdown, and what is written for it.
_ESCAPES = [
    (re.compile(r"([\\*`\[\]_])"), r"\\\1"), (re.compile(r"^(\s*)(-|\+ |=+|#{1,6} |~~~|>)"), r"\1\\\2"), (re.compile(r"^(\s*\d+)\. "), r"\1\\. "),
]


class _Tree(HTMLParser):
    """Elements as [name, attributes, children]; text as strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "pre", "blockquote") and self.open[-1][0] == "p" or tag == "li" == self.open[-1][0]:
            self.open.pop()
        if tag in ("td", "th", "tr") and self.open[-1][0] in ("td", "th"):
            self.open.pop()
        if tag == "tr" == self.open[-1][0]:
            self.open.pop()
        e = [tag, dict(attrs), []]
        self.open[-1][2].append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree(html: str) -> list:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def text_of(e) -> str:
    return e if isinstance(e, str) else "" if e[0] in _SKIP else "".join(map(text_of, e[2]))


def _find(e, test) -> Iterator[list]:
    todo = [e]
    while todo:
        e = todo.pop()
        if not isinstance(e, str):
            if test(e):
                yield e
            todo += reversed(e[2])


def content_root(root: list) -> list:
    """The first of main, article, .content, #content that has text; else the body; else the whole."""
    kinds = (
        lambda e: e[0] == "main", lambda e: e[0] == "article", lambda e: "content" in (e[1].get("class") or "").split(), lambda e: e[1].get("id") == "content",
    )
    for kind in kinds:
        first = next(_find(root, kind), None)
        if first is not None and text_of(first).strip():
            return first
    return next(_find(root, lambda e: e[0] == "body"), root)


def escape(text: str) -> str:
    for pattern, to in _ESCAPES:
        text = pattern.sub(to, text)
    return text


def markdown(e, escaped: bool = False, marker: str = "-   ") -> str:
    """ATX headings, - bullets and numbers, nested lists indented, fenced code, inline marks; cells of tables are blocks.
    marker: what an item begins with. escaped: marks within texts are written so that they stay text."""
    if isinstance(e, str):
        text = " ".join(e.split("\n")) if e.strip() else (" " if e else "")
        return escape(text) if escaped else text
    tag, attrs, children = e
    if tag in _SKIP or tag == "head":
        return ""
    if tag == "pre":
        code = text_of(e).strip("\n")
        fence = "`" * max(3, 1 + max(map(len, re.findall("^`{3,}", code, re.M)), default=0))
        return f"\n\n{fence}\n{code}\n{fence}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "img":
        return f"![{attrs.get('alt') or ''}]({attrs['src']})" if attrs.get("src") else ""
    if tag == "code":
        code = text_of(e)
        ticks = "`" * (1 + max(map(len, re.findall("`+", code)), default=0))
        pad = " " if code.startswith("`") or code.endswith("`") else ""
        return f"{ticks}{pad}{code}{pad}{ticks}" if code else ""
    inner = "".join(markdown(c, escaped, begin) for c, begin in _marked(e))
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * int(tag[1])} {' '.join(inner.split())}\n\n"
    if tag == "li":
        lines = re.sub(r"\n{3,}", "\n\n", inner.strip()).split("\n")
        return f"\n{marker}" + "\n".join([lines[0], *(f"    {x}" if x.strip() else "" for x in lines[1:])]) + "\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {x}" for x in re.sub(r"\n{3,}", "\n\n", inner.strip()).split("\n")) + "\n\n"
    if tag == "a":
        return f"[{inner.strip()}]({attrs['href']})" if attrs.get("href") and inner.strip() else inner
    if tag in ("b", "strong") and inner.strip():
        return f"**{inner.strip()}**"
    if tag in ("i", "em") and inner.strip():
        return f"_{inner.strip()}_"
    return f"\n\n{inner.strip()}\n\n" if tag in _BLOCK else inner


def _marked(e: list) -> Iterator[tuple[list | str, str]]:
    """An element's children and how they begin if they are items: numbers count from the list's start."""
    first = e[1].get("start") or "1"
    number = int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1
    for c in e[2]:
        item = e[0] == "ol" and not isinstance(c, str) and c[0] == "li"
        yield c, f"{number}.  " if item else "-   "
        number += item


def to_markdown(html: str | None, escaped: bool = False) -> str:
    """Trimmed; empty on any failure."""
    try:
        lines = [x.rstrip() if not x.endswith("  ") else x for x in markdown(content_root(tree(html or "")), escaped).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    except Exception:
        return ""


def pages_to_markdown(pages: DataFrame, carry: list[str], escaped: bool = False) -> DataFrame:
    given = pages.select(*carry, F.col("html").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[carry].assign(markdown=[to_markdown(h, escaped) for h in b["__html"]])

    return given.mapInPandas(run, f"{schema}, markdown string")


def links(pages: DataFrame, form: Callable[[Column], Column] = urls.normalised) -> DataFrame:
    """src, dst: links of pages (url, html) to addresses whose text starts with the page's origin, both normalised (or in
    another form, such as urls.standard), once each. Fragments and other origins are left out; relative ones that start with / are made whole."""
    origin = F.lower(F.regexp_extract("url", r"^(?i)(https?://[^/?#]+)", 1))
    refs = pages.select(F.col("url"), origin.alias("origin"), F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("href"))
    href = F.when(F.col("href").rlike("^/(?!/)"), F.concat("origin", "href")).otherwise(F.col("href"))
    whole = refs.filter("origin <> ''").select("url", "origin", href.alias("href")).filter(F.startswith("href", "origin"))
    return whole.select(form(F.col("url")).alias("src"), form(F.col("href")).alias("dst")).distinct()


def crawl(pages: DataFrame, edges: DataFrame, start: str, most: int = MOST_PAGES) -> list[tuple[str, int]]:
    """(url, depth) of up to `most` pages in breadth-first order (within a depth by URL) from start over edges (src, dst).
    Pages that aren't stored are visited but don't count. What reaches the driver is bounded by `most`: the pages counted,
    and of each depth only as many new ones as still count."""
    spark = pages.sparkSession
    have = pages.select(urls.normalised(F.col("url")).alias("url")).distinct()
    (frontier,) = spark.range(1).select(urls.normalised(F.lit(start)).alias("url")).first()
    level = have.filter(F.col("url") == frontier).select("url").limit(1).collect()
    done = [(r["url"], 0) for r in level]
    while level and len(done) < most:
        known = spark.createDataFrame([(u,) for u, _ in done], "url string")
        now = F.broadcast(spark.createDataFrame([(r["url"],) for r in level], "src string"))  # at most `most` rows
        new = edges.join(now, "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(have, "url", "left_semi").join(F.broadcast(known), "url", "left_anti")
        level = new.orderBy("url").limit(most - len(done)).collect()
        done += [(r["url"], done[-1][1] + 1) for r in level]
    return done
