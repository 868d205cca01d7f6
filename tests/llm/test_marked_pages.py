from docloom.llm import html


def test_alignment_judges_unmarked_lines_of_pages_with_an_article():
    a = html.blocks_of("<p>site name</p><h1>Own headline</h1><article><p>story</p><p>refrain</p></article><p>imprint</p><aside>x</aside>")
    b = html.blocks_of("<p>site name</p><h1>Other</h1><article><p>tale</p><p>refrain</p></article><p>imprint</p><aside>y</aside>")
    lines = lambda page: [t for _, t in page]
    assert html.main_text(a, lines(b)) == "Own headline\nstory\nrefrain" and html.main_text(b, lines(a)) == "Other\ntale\nrefrain"
    assert html.main_text(a, None) == "story\nrefrain"
