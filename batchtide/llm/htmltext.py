"""Visible text of web pages, laid out as a reader sees it.

A page is cut into tags and text, and a tree is built with the tags that HTML
leaves out: the head ends at the first text or tag that it can't hold, a
paragraph ends where a block begins, a list item, cell or row where the next one
does, cells get their row, void elements have no content.  What is not shown is
left out: head, scripts, styles, templates, comments, definitions and
descriptions in svg, annotations in math, elements that are hidden by attribute
or inline style.  Text keeps the spacing
of blocks (a blank line around paragraphs and headings, a line for divisions and
breaks), lists have their marks and indents, table columns are aligned (with spans of up
to 1,000 columns and 65,534 rows, as HTML has it), and preformatted text stays
as it is.

The walk uses stacks of its own, so depth is bounded by memory only.  Broken
markup never fails: an end tag that closes nothing is dropped.  A null or empty
page has empty text.  Every row, repeated ones too, gives a row; a null id stays
null; an empty table gives an empty result; other columns, of whatever name, are
not read.  Very long pages are rendered whole, in time and space in proportion.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object datalist meta link".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd tr caption figcaption legend details summary option thead tbody tfoot center".split())
#: What a start tag ends, and where looking for that stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)),
}
#: What an open head may hold; any other start tag ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
FOREIGN = ("svg", "math")
#: Elements of svg and math whose content is HTML again, and tags that end svg and math elsewhere.
HTML_IN = ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
UNSEEN_IN = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset(("annotation", "annotation-xml")),
}
_UNQUOTED = re.compile(r"=\s*[^\s\"'=>]+/\Z")
_BLANK = " \t\n\r\f"
#: How wide a table column is made for its cells, and how many blanks stand for left-out columns.
WIDEST, MOST_PAD = 60, 1000
_SCOPE = ("td", "th", "table", "button", "body", "html")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(page: str) -> Node:
    root = Node("#root", {})
    stack, at, size = [root], 0, len(page)
    open_tags: dict[str, list[int]] = {}  # where each tag's open elements are in the stack

    def pop() -> None:
        open_tags[stack.pop().tag].pop()

    def inmost(tags) -> int:
        return max((open_tags[t][-1] for t in tags if open_tags.get(t)), default=0)

    def close(tags, stop) -> None:
        """Ends the innermost open element of these tags, unless one of stop stands before it."""
        at = inmost(tags)
        if at and at >= inmost(stop):
            while len(stack) > at:
                pop()

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        open_tags.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def text(s: str) -> None:
        s = html.unescape(s)
        if stack[-1].tag == "head" and s.strip(_BLANK):
            pop()
        stack[-1].children.append(s)

    headed = False
    while at < size:
        m = _TOKEN.search(page, at) if page.find(">", at) >= 0 or page.find("<!--", at) >= 0 else None
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                close((tag,), () if tag in ("table", "body", "html") else ("table",) if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else ())
            elif tag == "br":
                if stack[-1].tag == "head":
                    pop()
                stack[-1].children.append(Node("br", {}))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        foreign = any(open_tags.get(t) for t in FOREIGN) and not any(open_tags.get(t) for t in HTML_IN)
        if foreign and tag in BREAKOUT:
            close(FOREIGN, ())
            foreign = False
        if tag == "head":
            if headed or stack[-1].tag not in ("#root", "html"):
                continue
            headed = True
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        if tag in BLOCK:
            close(("p",), _SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr", {}))
        node = Node(tag, attributes)
        if tag in VOID or (foreign and m[3].endswith("/") and not _UNQUOTED.search(m[3])):
            stack[-1].children.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            inner = page[at : end.start() if end else size]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            stack[-1].children.append(node)
            at = end.end() if end else size
        else:
            push(node)
    return root


def shown(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in UNSEEN or "hidden" in a or ("style" in a and _HIDING.search(a["style"])) or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a))


class _Out:
    """Text with collapsed spaces and at most the line breaks that blocks ask for."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = self.space = 0
        self.indent = ""
        self.mark = ""

    def write(self, s: str) -> None:
        if self.parts and self.breaks:
            self.parts.append("\n" * self.breaks)
        if not self.parts or self.breaks:
            self.parts.append(self.mark or self.indent)
            self.mark = ""
        elif self.space:
            self.parts.append(" ")
        self.parts.append(s)
        self.breaks = self.space = 0

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = 1
        if body := words.strip(" "):
            self.write(body)
            self.space = int(words[-1] == " ")

    def lines(self, rows: list[str]) -> None:
        for i, r in enumerate(rows):
            if i:
                self.breaks = max(self.breaks, 1)
            if r:
                self.write(r)
            else:
                self.breaks += 1

    def block(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.space = 0

    def done(self) -> str:
        return "".join(self.parts)


def _number(value: str | None, most: int) -> int:
    return min(int(value), most) if value and len(value) < 10 and value.isdecimal() else most if value and value.isdecimal() else 1


class _Table:
    """The cells of a table by their column, with those that reach down from earlier rows."""

    def __init__(self, depth: int):
        self.rows: list[list[tuple[int, str]]] = []
        self.depth = depth
        self.loose: list[str] = []
        self.spans: list[tuple[int, int, float]] = []  # first column, end, further rows
        self.taken: list[tuple[int, int]] = []  # of this row, last first
        self.at = 0

    def group(self) -> None:
        """A group of rows begins or ends: no cell reaches beyond."""
        self.spans, self.taken = [], []

    def row(self) -> None:
        self.rows.append([])
        self.at = 0
        self.taken = sorted(((a, b) for a, b, _ in self.spans), reverse=True)
        self.spans = [(a, b, n - 1) for a, b, n in self.spans if n > 1]

    def cell(self, s: str, attributes: dict[str, str]) -> None:
        if not self.rows:
            self.row()
        while self.taken and self.taken[-1][0] <= self.at:
            self.at = max(self.at, self.taken.pop()[1])
        end = self.at + max(1, _number(attributes.get("colspan"), 1000))
        down = _number(attributes.get("rowspan"), 65534)
        if down != 1:
            self.spans.append((self.at, end, down - 1 if down else float("inf")))
        self.rows[-1].append((self.at, s))
        self.at = end

    def lines(self) -> list[str]:
        """Rows as lines, each column as wide as its widest cell, up to WIDEST; columns where no cell begins have no width.

        A longer cell stands as it is and pushes on what follows; no more than
        MOST_PAD blanks stand for columns that a row leaves out.  So a page's text is
        never longer than a fixed multiple of the page.
        """
        widths: dict[int, int] = {}
        for r in self.rows:
            for i, c in r:
                widths[i] = min(WIDEST, max(widths.get(i, 0), len(c)))
        columns = sorted(widths)
        number = {c: i for i, c in enumerate(columns)}
        begin = [0]
        for c in columns:
            begin.append(begin[-1] + widths[c] + 2)
        out = []
        for r in self.rows:
            if any(c for _, c in r):
                parts, seen = [], 0
                for i, c in r:
                    if number[i] > seen:
                        left_out = begin[number[i]] - begin[seen] - 2
                        parts.append(" " * min(left_out, MOST_PAD))
                    parts.append(c.ljust(widths[i]))
                    seen = number[i] + 1
                out.append("  ".join(parts).rstrip())
        return out


def render(root: Node) -> str:
    outs, tables, lists = [_Out()], [], []
    inside = dict.fromkeys(FOREIGN, 0)
    work: list = [(root, False)]
    pre = 0
    while work:
        node, leaving = work.pop()
        out = outs[-1]
        if isinstance(node, str):
            if pre:
                out.lines(node.expandtabs(8).split("\n"))
            elif not (tables and tables[-1].depth == len(outs)):  # between cells there is no text
                out.text(node)
            elif node.strip():
                tables[-1].loose.append(" ".join(node.split()))
            continue
        tag = node.tag
        if not leaving:
            if not shown(node) or any(n and tag in UNSEEN_IN[t] for t, n in inside.items()):
                continue
            if tag == "br":
                out.breaks += 1
                out.space = 0
                continue
            if tag in VOID:
                if tag == "hr":
                    out.block(2)
                elif tag == "input" and node.attributes.get("value") and node.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search"):
                    out.text(f" {node.attributes['value']} ")
                continue
            if tag in BLOCK:
                out.block(2 if tag in SPACED and not lists else 1)
            if tag == "table":
                tables.append(_Table(len(outs)))
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].group()
            elif tag in ("td", "th", "caption") and tables:
                outs.append(_Out())
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag, int(node.attributes["start"]) if node.attributes.get("start", "").isdecimal() else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                depth = "  " * max(0, len(lists) - 1)
                out.mark, out.indent = depth + mark, depth + " " * len(mark)
            elif tag == "pre":
                pre += 1
            elif tag in FOREIGN:
                inside[tag] += 1
            elif tag == "text" and inside["svg"]:
                out.block(1)
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("td", "th", "caption") and tables and len(outs) > tables[-1].depth:
            cell = " ".join(outs.pop().done().split())
            if tag == "caption":
                tables[-1].loose.append(cell)
            else:
                tables[-1].cell(cell, node.attributes)
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].group()
        elif tag == "table" and tables:
            table = tables.pop()
            del outs[table.depth :]
            out = outs[-1]
            out.lines([*filter(None, table.loose), *table.lines()])
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
            depth = "  " * len(lists)
            out.indent, out.mark = depth if lists else "", ""
        elif tag == "li":
            out.mark, out.indent = "", "  " * max(0, len(lists) - 1)
        elif tag == "pre":
            pre -= 1
        elif tag in FOREIGN:
            inside[tag] -= 1
        elif tag == "text" and inside["svg"]:
            outs[-1].block(1)
        if tag in BLOCK:
            outs[-1].block(2 if tag in SPACED and not lists else 1)
    return outs[0].done()


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """page_id, text, n_chars and n_words of every page."""
    p = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{page}`").cast("string").alias("page"))

    def run(batch):
        keys, all_pages = batch.column("page_id"), batch.column("page")
        for lo in range(0, batch.num_rows, 256):
            text = [page_text(x) for x in all_pages.slice(lo, 256).to_pylist()]
            yield {"page_id": keys.slice(lo, 256), "text": text, "n_chars": [len(t) for t in text], "n_words": [len(t.split()) for t in text]}

    return shared.arrow(p, run, "page_id long, text string, n_chars long, n_words long")
