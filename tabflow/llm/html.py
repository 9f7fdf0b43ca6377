"""Operator 7: layout-aware rendering of HTML to plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.llm.common import bounded_batches, by_volume, tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag; in the first group character references count.
RCDATA = frozenset(["textarea", "title"])
RAW = frozenset("script style xmp iframe noembed noframes noscript".split()) | RCDATA
#: Never rendered.
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe datalist audio video canvas object svg math base link meta param source track area".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
#: Blocks with an empty line before and after.
SPACED_BLOCK = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split()
)
#: What a start tag closes, and the elements that such a search never leaves.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
for _tags, _closes, _stops in (
    ("li", "li", "ul ol menu dir table td th"),
    ("dt dd", "dt dd", "dl table td th"),
    ("option", "option", "select datalist optgroup"),
    ("optgroup", "option optgroup", "select datalist"),
    ("tr", "tr td th caption colgroup", "table"),
    ("td th", "td th caption", "tr table"),
    ("thead tbody tfoot", "tr td th thead tbody tfoot caption colgroup", "table"),
    ("caption colgroup", "caption colgroup", "table"),
    ("rt rp", "rt rp", "ruby"),
):
    for _t in _tags.split():
        IMPLIED[_t] = (frozenset(_closes.split()), frozenset(_stops.split()))
P_STOPS = frozenset("table td th caption button object template html body".split())
END_STOPS = frozenset("table td th caption template html".split())
#: Levels of lists and quotes that indent: browsers build trees of at most 512 levels.
MAX_LEVELS = 512

#: In a tag a quote opens a value right after "=" only; others are ordinary characters.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+)*+(?:>|\Z)|</[^a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"(?:([a-z][\w-]*)|\*)?((?:[.#][\w-]+)*)", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "lines")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.lines = tag, attrs, parent, [], None


def _attributes(token: str, begin: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(token, begin, len(token) - token.endswith(">")):
        name = m[1].lower()
        if name not in out:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            out[name] = unescape(value) if "&" in value else value
    return out


def build(html: str) -> tuple[Node, list[str], str]:
    """The tree of a page with implied tags, its style sheets, and its title.

    Start tags close what they imply closed (paragraphs, items, rows, cells, options); an end
    tag closes up to its element unless a table, cell or caption stands between; end tags
    without an element are ignored, but ``</p>`` is a paragraph and ``</br>`` a break.
    """
    root = Node("html", {}, None)
    at, styles, title = root, [], ""
    place, n = 0, len(html)
    opened: dict[str, int] = {}  # so that no search begins for what isn't open

    def close(upto: Node) -> Node:
        """Close all elements from the current one up to ``upto``; its parent is current then."""
        node = at
        while node is not upto.parent:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while place < n:
        m = _TOKEN.search(html, place)
        if m is None:
            if place < n:
                at.children.append(unescape(html[place:]))
            break
        if m.start() > place:
            text = html[place : m.start()]
            at.children.append(unescape(text) if "&" in text else text)
        token, place = m[0], m.end()
        if token[1] in "!?" or not token.endswith(">"):
            continue
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag == "br":
                at.children.append(Node("br", {}, at))
                continue
            if not opened.get(tag):
                if tag == "p":
                    at.children.append(Node("p", {}, at))
                continue
            node = at
            while node is not root and node.tag != tag and node.tag not in END_STOPS:
                node = node.parent
            if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption") and node.tag != tag:
                node = at
                while node is not root and node.tag != tag and (tag == "table" or node.tag != "table"):
                    node = node.parent
            if node is not root and node.tag == tag:
                at = close(node)
            elif tag == "p":
                at.children.append(Node("p", {}, at))
            continue
        attrs = _attributes(token, name.end()) if name.end() < len(token) - 1 else {}
        if tag in ("html", "body"):
            if tag == "body":
                while at.tag == "head" or (at.parent is not None and at.parent.tag == "head"):
                    at = close(at)
            if tag == "html" or opened.get("body"):
                root.attrs = {**attrs, **root.attrs}
                continue
        if tag in IMPLIED and any(opened.get(t) for t in IMPLIED[tag][0]):
            closes, stops = IMPLIED[tag]
            node, ended = at, None
            while node is not root and node.tag not in stops:
                if node.tag in closes:
                    ended = node
                    if len(closes) == 1 or tag in ("dt", "dd", "td", "th"):
                        break
                node = node.parent
            if ended is not None:
                at = close(ended)
        if tag in ENDS_P and opened.get("p"):
            node = at
            while node is not root and node.tag != "p" and node.tag not in P_STOPS:
                node = node.parent
            if node.tag == "p":
                at = close(node)
        if at.tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            at = close(at)
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, place)
            text = html[place : end.start() if end else n]
            place = end.end() if end else n
            if tag in RCDATA:
                text = unescape(text)
            if tag == "style":
                styles.append(text)
            elif tag == "title" and not title:
                title = _SPACE.sub(" ", text).strip()
            node.children.append(text)
        elif tag not in VOID and not (token.endswith("/>") and tag in ("svg", "math", "path")):
            at = node
            opened[tag] = opened.get(tag, 0) + 1
    return root, styles, title


def unseen_rules(styles: list[str]) -> list[tuple[str, frozenset[str], str]]:
    """Simple selectors (element, classes, id) that the page's style sheets hide."""
    rules = []
    for sheet in styles:
        if "none" not in sheet and "hidden" not in sheet and "collapse" not in sheet:
            continue
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if _UNSEEN.search(body):
                for s in selectors.split(","):
                    m = _SIMPLE.fullmatch(s.strip())
                    if m and s.strip():
                        marks = re.findall(r"[.#][\w-]+", m[2])
                        rules.append(((m[1] or "").lower(), frozenset(x[1:] for x in marks if x[0] == "."), next((x[1:] for x in marks if x[0] == "#"), "")))
    return rules


def hidden(node: Node, rules: list[tuple[str, frozenset[str], str]]) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset")):
        return True
    if node.tag == "dialog" and "open" not in a:
        return True
    if "style" in a and _UNSEEN.search(a["style"]):
        return True
    if rules:
        classes = set(a.get("class", "").split())
        return any((not t or t == node.tag) and c <= classes and (not i or i == a.get("id")) and (t or c or i) for t, c, i in rules)
    return False


class _Page:
    """Lines of text with collapsed spaces, margins between blocks, and indents of lists and quotes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indents: list[str] = [""]
        self.mark = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " ":
            self.space, s = True, s[1:]
        if not s:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = s[-1] == " "
        self.line.append(s[:-1] if self.space else s)

    def flush(self) -> None:
        if self.line or self.mark:
            self._margin()
            self.lines.append((self.indents[-1][: len(self.indents[-1]) - len(self.mark)] + self.mark + "".join(self.line)).rstrip())
            self.mark = ""
        self.line, self.space = [], False

    def _margin(self) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False

    def break_(self) -> None:
        if self.line or self.mark:
            self.flush()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, spaced: bool) -> None:
        if self.line:
            self.flush()
        self.blank = self.blank or spaced

    def verbatim(self, lines: list[str]) -> None:
        self.block(False)
        for s in lines:
            self._margin()
            self.lines.append((self.indents[-1][: len(self.indents[-1]) - len(self.mark)] + self.mark + s).rstrip())
            self.mark = ""


def _number(node: Node, name: str, otherwise: int, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"-?\d{1,9}", value) else otherwise


def render_lines(top: Node, rules: list) -> list[str]:
    """The visible lines of an element.  Tables inside it have their lines already."""
    page = _Page()
    stack: list[tuple[Node | str | tuple, bool]] = [(top, False)]
    counters: list[int | None] = []
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            page.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag == "li" or tag == "dd" or tag == "blockquote":
                page.block(False)
                if page.mark:
                    page.flush()
                page.indents.pop()
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            page.block(tag in SPACED_BLOCK and not (tag in ("ul", "ol", "menu") and counters))
            continue
        if node is not top and hidden(node, rules):
            continue
        if tag == "br":
            page.break_()
            continue
        if tag == "input":
            page.text(node.attrs.get("value", ""))
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag in BLOCK and node is not top:
            page.block(tag in SPACED_BLOCK and not (tag in ("ul", "ol", "menu") and counters))
            if node.lines is not None:
                page.verbatim(node.lines)
                page.block(True)
                continue
            if tag in ("pre", "xmp", "textarea"):
                text = _plain(node, rules).removeprefix("\n")
                page.verbatim(text.expandtabs(8).split("\n") if text else [])
                page.block(True)
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                counters.append(_number(node, "start", 1, 10**9) if tag == "ol" else None)
            elif tag == "li":
                n = counters[-1] if counters else None
                if n is not None:
                    n = _number(node, "value", n, 10**9)
                    counters[-1] = n + 1
                page.mark = "- " if n is None else f"{n}. "
                page.indents.append(page.indents[-1] + " " * len(page.mark) if len(page.indents) <= MAX_LEVELS else page.indents[-1])
            elif tag in ("dd", "blockquote"):
                page.indents.append(page.indents[-1] + "  " if len(page.indents) <= MAX_LEVELS else page.indents[-1])
            stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    page.flush()
    return page.lines


def _plain(top: Node, rules: list) -> str:
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node is top or not hidden(node, rules):
            if node.tag == "br":
                out.append("\n")
            stack.extend(reversed(node.children))
    return "".join(out)


def table_lines(table: Node, rules: list) -> list[str]:
    """Rows of aligned cells, two spaces apart; spans keep their columns; the caption comes first."""
    rows: list[list[Node]] = []
    caption: list[str] = []
    loose: list[Node | str] = []
    stack: list[Node | str] = list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                loose.append(node)
        elif hidden(node, rules):
            continue
        elif node.tag in ("thead", "tbody", "tfoot"):
            stack.extend(reversed(node.children))
        elif node.tag == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c, rules)])
            loose += [c for c in node.children if not (isinstance(c, Node) and c.tag in ("td", "th")) and (isinstance(c, Node) or c.strip())]
        elif node.tag in ("td", "th"):
            rows.append([node])
        elif node.tag == "caption":
            caption += render_lines(node, rules)
        elif node.tag not in ("col", "colgroup"):
            loose.append(node)
    out: list[str] = []
    if loose:  # what stands in a table outside its cells is shown before it
        held = Node("div", {}, None)
        held.children = loose
        out += render_lines(held, rules)
    out += caption
    grid: list[list[tuple[int, int, list[str]]]] = []
    below: dict[int, int] = {}
    widths: dict[int, int] = {}
    for row in rows:
        placed, col = [], 0
        for cell in row:
            while below.get(col, 0) > 0:
                col += 1
            span, down = max(1, _number(cell, "colspan", 1, 1000)), max(1, _number(cell, "rowspan", 1, 65534))
            lines = [s for s in render_lines(cell, rules) if s]
            placed.append((col, span, lines))
            width = max(map(len, lines), default=0)
            if span == 1:
                widths[col] = max(widths.get(col, 0), width)
            for c in range(col, col + span):
                if down > 1:
                    below[c] = down
            col += span
        below = {c: d - 1 for c, d in below.items() if d > 1}
        grid.append(placed)
    last = max((c + s for r in grid for c, s, _ in r), default=0)
    begins, x = [0], 0
    for c in range(last):
        x += widths.get(c, 0) + (2 if widths.get(c) else 0)
        begins.append(x)
    for placed in grid:
        for k in range(max((len(lines) for *_, lines in placed), default=0)):
            line = ""
            for col, _, lines in placed:
                if k < len(lines) and lines[k]:
                    line = line.ljust(begins[col]) if len(line) <= begins[col] - 2 or not line else line + "  "
                    line += lines[k]
            out.append(line)
    return out


def render(html: str | None) -> tuple[str, str]:
    """The visible text and the title of a page."""
    if not html:
        return "", ""
    root, styles, title = build(html)
    rules = unseen_rules(styles)
    tables, stack = [], [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, Node):
                if c.tag == "table":
                    tables.append(c)
                stack.append(c)
    for t in reversed(tables):  # inner tables first
        t.lines = table_lines(t, rules)
    lines = render_lines(root, rules)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).lstrip("\n"), title


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``carry`` columns with title, text (all visible text in layout) and n_chars of each page.

    A null or empty page has the empty title and text.  Pages are rendered a few at a time,
    each by itself; rows, also repeated ones, keep their own results.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__tf_html").to_pylist()
            for part in by_volume(texts, 1 << 21):
                done = [render(t) for t in texts[part]]
                rows = batch.slice(part.start, part.stop - part.start)
                cols = [pa.array([d[1] for d in done], pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([len(d[0]) for d in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carry], *cols], names=[*carry, "title", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    made = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*[pages.schema[c] for c in carry], *made])
    return pages.select(*carry, F.col(html_col).cast("string").alias("__tf_html")).mapInArrow(work, schema)
