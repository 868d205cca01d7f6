"""Markdown to text by its syntax, and web pages to Markdown."""

import time

import pytest

from docloom.sources import commonmark, files, web

# fmt: off
CASES = [
    ('# Head\n\n* **bold** [link](u)\n', 'Head\n\nbold link'),
    ('Title\n=====\ntext', 'Title\n\ntext'),
    ('a\n---\nb', 'a\n\nb'),
    ('***\n---\n___\n+++', '+++'),
    ('    code\n\n    more', 'code\n\nmore'),
    ('```py\nx = *1*\n```\nafter', 'x = *1*\n\nafter'),
    ('~~~~\na\n~~~\nb\n~~~~', 'a\n~~~\nb'),
    ('> quote\n> more\nlazy\n\nout', 'quote\nmore\nlazy\n\nout'),
    ('> # h\n> > deep', 'h\n\ndeep'),
    ('- a\n- b\n  - c\n    d', 'a\n\nb\n\nc\nd'),
    ('1. one\n2. two', 'one\n\ntwo'),
    ('text\n2. no list', 'text\n2. no list'),
    ('text\n1. list', 'text\n\nlist'),
    ('- a\n\n  b\n\n      code', 'a\n\nb\n\ncode'),
    ('*a* **b** ***c*** _d_ __e__', 'a b c d e'),
    ('snake_case_name and 2*3*4', 'snake_case_name and 234'),
    ('a * b * c', 'a * b * c'),
    ('**foo*', '*foo'),
    ('*foo**bar**baz*', 'foobarbaz'),
    ('***foo** bar*', 'foo bar'),
    ('*foo [bar*](u)', '*foo bar*'),
    ('\\*not\\* \\# x', '*not* # x'),
    ('`a*b*` ``c`d``', 'a*b* c`d'),
    ('`` ` ``', '`'),
    ('&copy; &amp;amp; &#65; &nope;', '© &amp; A &nope;'),
    ('[text](<a b> "t") and [x](y \'z\')', 'text and x'),
    ('![alt *text*](i.png)', 'alt text'),
    ('[a][b] [b] [b][] [c]\n\n[b]: /u "t"', 'a b b [c]'),
    ('[b]: /u\ntext', 'text'),
    ('<http://a.b/c> <me@x.org>', 'http://a.b/c me@x.org'),
    ('a <b>x</b> c', 'a <b>x</b> c'),
    ('<div>\n*x*\n</div>\n\ny', '<div>\n*x*\n</div>\n\ny'),
    ('line  \nbreak\\\nagain', 'line\nbreak\nagain'),
    ('## closed ##', 'closed'),
    ('#no', '#no'),
    ('####### seven', '####### seven'),
    ('#', ''),
    ('[link [in](a)](b)', '[link in](b)'),
    ('a\tb', 'a\tb'),
    ('\tcode', 'code'),
    ('- ```\n  x\n  ```\n- y', 'x\n\ny'),
    ('> ```\n> a\n> ```', 'a'),
    ('', ''),
    ('*\n', ''),
    ('+ a\n+ b', 'a\n\nb'),
    ('10) ten', 'ten'),
    ('1234567890. no', '1234567890. no'),
    ('-no', '-no'),
    ('- - nested', 'nested'),
    ('> - a\n> - b', 'a\n\nb'),
    ('- > q', 'q'),
    ('a\n\n\n\nb', 'a\n\nb'),
    ('**a\nb**', 'a\nb'),
    ('`a\nb`', 'a b'),
    ("[a]\n\n[a]: <u v> 'x'\n", 'a'),
    ('![i][a]\n\n[A]: /u', 'i'),
    ('~~~ x\n\ny\n~~~', '\ny'),
    ('a ***b** c*', 'a b c'),
    ('__a_b__', 'a_b'),
    ('a\\\\b', 'a\\b'),
    ('<!-- c -->\n\nx', '<!-- c -->\n\nx'),
    ('[a](u "q" z)', '[a](u "q" z)'),
]
# fmt: on


@pytest.mark.parametrize(("source", "text"), CASES)
def test_plain_text(source, text):
    assert commonmark.plain(source) == text


@pytest.mark.parametrize("junk", ["a*** b### c%%% ", "`x ", "``` ", "[a ", "*a _b ", "- a\n  ", "> a\n", "![", "<a "])
def test_long_texts_take_linear_time(junk):
    at = time.time()
    commonmark.plain(junk * 50_000)
    assert time.time() - at < 10


def test_too_deep_or_empty_is_as_it_stands():
    deep = "> " * 5000 + "x"
    assert files.markdown_text(deep) == deep and files.markdown_text("***\n") == "***\n"


HTML = [
    ("<ol start=3><li>one<li>two<ul><li>in<p>para</ul></ol>", "3.  one\n\n4.  two\n\n    -   in\n\n        para"),
    ("<ol><li>a</li><li><ol><li>b</li></ol></li></ol>", "1.  a\n\n2.  1.  b"),
    ("<ol start=x><li>a</ol><ul><li>b</ul>", "1.  a\n\n-   b"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"),
    ("<dl><dt>t<dd>d</dl>", "t\n\nd"),
    ("<p>1. x *y* _z_ [q] `c` \\</p><p># no</p><p>- no</p><p>a - b</p>", "1\\. x \\*y\\* \\_z\\_ \\[q\\] \\`c\\` \\\\\n\n\\# no\n\n\\- no\n\na - b"),
    ("<pre>x\n```\ny</pre><code>a`b</code><code>*</code>", "````\nx\n```\ny\n````\n\n``a`b```*`"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<a href='/u'><b>x</b></a> <i> </i><img src=i alt=*>", "[**x**](/u)  ![*](i)"),
]


@pytest.mark.parametrize(("html", "markdown"), HTML)
def test_pages_to_markdown(html, markdown):
    assert web.to_markdown(f"<body><nav>x</nav><main>{html}</main>", escaped=True) == markdown


def test_escaped_markdown_reads_back():
    said = "5. *not* _marks_ [here] `ticks` # > - <tag> &amp; \\ end"
    assert commonmark.plain(web.to_markdown(f"<main><p>{said.replace('&', '&amp;').replace('<', '&lt;')}</p></main>", escaped=True).replace("<", "\\<").replace("&", "\\&")) == said
