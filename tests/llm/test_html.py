import re
from collections import Counter
from html.parser import HTMLParser

import time

import pytest

from tabflow.llm import html as M
from tabflow.llm.html import extract, render

CASES = [
    ("<p>One   <b>two</b>three<br>four<p>five", "One twothree\nfour\n\nfive"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("x<div hidden>no</div>y<div style='DISPLAY : none'>no</div><span style='visibility:hidden'>no</span>z", "xyz"),
    ("<style>.ad, #top { display: none } p.x{color:red}</style><p class='big ad'>no</p><p class=x>yes</p><p id=top>no", "yes"),
    ("<script>var t='<p>no</p>';</script>a<!-- no --> b<noscript>no</noscript>", "a b"),
    ("<title>T</title>body", "body"),
    ("a&amp;b &lt;c&gt; &#233; &eacute; &am &amp", "a&b <c> é é &am &"),
    ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>", "Name       Qty\napple pie  3"),
    ("<table><caption>Cap</caption><tr><td colspan=2>wide one here<td>x<tr><td>a<td>b<td>c</table>", "Cap\nwide one here  x\na  b  c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a     b\ni  j"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("a</p>b", "a\n\nb"),
    ("<select><option>o1<option>o2</select>", "o1\no2"),
    ("<h1>T</h1>text<hr>more", "T\n\ntext\n\nmore"),
    ("a <a href='x>y'>b</a> c", "a b c"),
    ("<div><p>x</div>y", "x\n\ny"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("", ""),
    ("<b", ""),
    ("a<!-- unclosed", "a"),
    ("<table><tr><td>1<tr><td>22</table>\n", "1\n22"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_rendering(page, want):
    got = "\n".join(x.rstrip() for x in render(page)[0].split("\n"))
    assert got.rstrip() == want


def test_title():
    assert render("<title> A &amp;\n B </title>x")[1] == "A & B"


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x", "<table><tr><td>" * 400 + "x", "<ul><li>" * 3000 + "x", "<p><b>" * 20000, "</div>" * 50000, "<a b='" * 5000, "<" * 50000, "&" * 50000, "<!--" * 20000])
def test_bad_pages_take_linear_time(page):
    began = time.process_time()
    render(page)
    assert time.process_time() - began < 5


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert "<" not in r.text and "track(" not in r.text and r.n_chars == len(r.text) > 50
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>x", 3), (1, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    assert [r.text for r in extract(odd).collect()] == ["", "", "x", "x"]
    assert extract(odd.limit(0)).count() == 0


def test_wide_cells_align():
    rows = [("a" * 90, "b"), ("c", "d" * 70), ("e", "f")]
    page = "<table>" + "".join(f"<tr><td>{x}<td>{y}<td>z" for x, y in rows) + "</table>"
    lines = M.render(page)[0].split("\n")
    assert {line.rindex("z") for line in lines} == {90 + 2 + 70 + 2}
    assert [line.index(y) for line, (_, y) in zip(lines, rows, strict=True)] == [92] * 3


def test_deep_nesting_indents():
    depth = 60
    text = M.render("<blockquote>" * depth + "deep" + "</blockquote>" * depth)[0]
    assert text == "  " * depth + "deep"
    far = M.render("<ul><li>" * 3000 + "x")[0].split("\n")[-1]
    assert far.strip("- ") == "x" and len(far) <= 2 * (M.MAX_LEVELS + 2) + 2


class Plain(HTMLParser):
    """The visible words of a well-formed page, in no layout: an independent reading of what must be shown."""

    SKIP = {"script", "style", "head", "title", "template", "noscript", "svg", "iframe"}

    def __init__(self):
        super().__init__()
        self.hidden, self.open, self.words = 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        unseen = tag in self.SKIP or "hidden" in a or "display:none" in style or "visibility:hidden" in style
        if tag not in M.VOID:
            self.open.append((tag, unseen))
            self.hidden += unseen
        self.words.append(" ")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                t, unseen = self.open.pop()
                self.hidden -= unseen
                if t == tag:
                    break
        self.words.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_all_visible_words_of_real_pages(spark, sf):
    """Of the test pages that close what they open, the words shown are those that an independent parser sees."""
    agreed = 0
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        want = Counter("".join(p.words).split())
        got = Counter(M.render(page)[0].split())
        marks = Counter({w: n for w, n in got.items() if w == "-" or re.fullmatch(r"\d+\.", w)})
        missing, more = want - got, got - want - marks
        agreed += not missing and not more
    assert agreed >= 0.9 * len(pages)
