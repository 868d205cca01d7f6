"""Every registered query runs on the smallest tables; those with SQL give DuckDB's rows."""

import re
from html import unescape

import pytest

from docloom import queries as base

from .oracle import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(spark, duck, FOLDER, base.QUERIES[name], base.SQL[name]) is None


def test_only_markdown_has_no_sql():
    assert set(base.QUERIES) - set(base.SQL) == {"page_markdown"}


def test_page_markdown(spark):
    """The words of each page's article, in order, between the marks of headings and emphasis."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = base.QUERIES["page_markdown"](spark, FOLDER).collect()
    assert sorted(r.page_id for r in rows) == sorted(html)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        bare = lambda t: re.sub(r"[\s*#]", "", t)
        assert bare(r.markdown) == bare(unescape(re.sub(r"<[^>]*>", "", inner))) and r.markdown.startswith("# ")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
