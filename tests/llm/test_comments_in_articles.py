"""Reader comments and teasers that pages write as articles, or within them, are no main text."""

import pytest

from docloom.llm import html

STORY = "<article class='post has-sidebar' id=main><h1>Title</h1><p>Story one.</p><p>Story two.</p>{}</article>{}"
WANT = "Title\nStory one.\nStory two."


@pytest.mark.parametrize(
    ("inside", "after"),
    [
        ("", "<article class='comment-body'>I disagree.</article>"),
        ("", "<article class=related-card><h3>Another story</h3><p>Teaser.</p></article>"),
        ("<ol class='responses'><li>Nice!</li><li>Agreed.</li></ol>", ""),
        ("<div class=cmt>I disagree.</div>", ""),
        ("<section id=comments><article><p>First!</p></article></section>", ""),
        ("<article><p>A reader says no.</p></article>", ""),
        ("<div itemprop='comment'><p>Hm.</p></div>", "<article itemprop=comment>Well.</article>"),
        ("<aside>Box</aside><form>Mail</form><div class='share-bar'>Share</div>", "<footer>Imprint</footer>"),
    ],
)
def test_comments_and_teasers(inside, after):
    page = html.blocks_of(f"<body><nav>Home</nav><main class='layout sidebar'>{STORY.format(inside, after)}</main></body>")
    assert html.main_text(page, None) == WANT and html.main_text(page, ["Home", "x"]) == WANT


def test_several_articles_of_a_page_stay():
    page = html.blocks_of("<main><article><p>One.</p></article><article class='entry comment-count'><p>Two.</p></article><section class=post><p>Three.</p></section></main>")
    assert html.main_text(page, None) == "One.\nThree."
    page = html.blocks_of("<main><article><p>One.</p></article><article class=entry><p>Two.</p></article></main>")
    assert html.main_text(page, None) == "One.\nTwo."


def test_a_very_long_page(spark):
    body = "<p>word word</p>\n" * 1_200_000
    df = spark.createDataFrame([(1, "https://a.org/x", f"<nav>m</nav><article>{body}<article>said</article></article>"), (2, "https://a.org/y", f"<p>{'y ' * 9}</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].n_chars == 10 * 1_200_000 - 1 and got[1].text.startswith("word word\nword") and got[2].text == ("y " * 9).strip()
