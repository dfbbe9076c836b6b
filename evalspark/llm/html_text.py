"""Layout-aware text of HTML pages.

A tree builder with void elements, implied end tags and raw-text elements; visibility
rules; and a renderer that gives all visible text with the spacing a reader sees:
white space collapses (kept in ``pre``), blocks start on lines of their own, paragraphs,
headings, lists and tables have a blank line around them, list items have their marker
and indent, and the cells of a table stand in aligned columns (spans included).

A null page is empty. Markup that is not closed ends with the page; elements nested
deeper than ``DEPTH`` are siblings of the one at that depth, as browsers have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepared

DEPTH = 150
COLUMNS = 1000  # of a table, at most, as browsers have it; more spans are one column wide
# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg math select datalist textarea input area param link meta base".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset form".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer nav main address li dt dd tr td th thead tbody tfoot caption details summary figcaption legend dialog hgroup search center option optgroup menu dir".split())
CLOSES_P = (BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())) | {"plaintext", "xmp"}
# start tag -> open elements it ends, and the elements that stop the search for them
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["caption"] = IMPLIED["colgroup"] = IMPLIED["thead"]
PARTS = frozenset("tr thead tbody tfoot colgroup".split())  # of a table, with other parts in them
ROW = frozenset("td th caption col".split())
SCOPE = frozenset("table td th caption button object template".split())  # end tags inside don't close what is outside
# of a tag: a quote opens a value only right after =, elsewhere it is a character of a name or value
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))"
_TOKEN = re.compile(rf"<!--(?:.*?-->|>|->|.*\Z)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}|(?!\s*+=)))*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}|\Z))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its tag, attributes and children (nodes and texts)."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[0] in "\"'" else value) if value else "")
    return found


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack, at = [root], 0

    def close(index: int) -> None:
        del stack[index:]

    def find(tags, stops) -> int:
        """The outermost open element of ``tags`` above the nearest of ``stops``; 0: none."""
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                found = i
        return found

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    look = 0
    while (start := page.find("<", look)) >= 0:
        m = _TOKEN.match(page, start)
        if not m:
            if page[start + 1:start + 2].isalpha() or page[start + 1:start + 2] == "/":
                text(at, start)
                return root  # the page ends inside a tag, which is then no text
            look = start + 1
            continue
        text(at, start)
        at = look = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # end tag
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag or (stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"))), 0):
                if stack[i].tag == tag:
                    close(i)
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in CLOSES_P and (i := find({"p"}, SCOPE)):
            close(i)
        if tag in IMPLIED and (i := find(*IMPLIED[tag])):
            close(i)
        if tag in ROW or tag in PARTS or tag == "form":
            # a part of a table ends what is open in it outside of cells; a form there holds nothing
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in SCOPE or stack[i].tag in PARTS), 0)
            if stack[i].tag == "table" or stack[i].tag in PARTS:
                if tag != "form":
                    close(i + 1)
                elif i == len(stack) - 1:
                    continue
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        source = m[3]
        node = Node(tag, _attributes(source) if source.strip(" /\n\t\r") else None)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            body = page[at:end.start() if end else len(page)]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = look = end.end() if end else len(page)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    text(at, len(page))
    return root


def visible(node: Node) -> bool:
    """Whether an element is shown."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _INVISIBLE.search(a["style"]))


class Lines:
    """Lines under construction; blank lines between blocks are made when text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []   # of the open line
        self.space = False           # white space waits before the next word
        self.gap = 0                 # 1: a new line, 2: a blank line before the next text

    def add(self, text: str) -> None:
        """Inline text; its white space collapses."""
        if not text:
            return
        words = _SPACE.sub(" ", text)
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        trailing = words[-1] == " "
        self._open()
        self.parts.append((" " if self.space and self.parts else "") + (words[:-1] if trailing else words))
        self.space = trailing

    def raw(self, text: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self._open()
                self.parts.append(line)

    def _open(self) -> None:
        if self.gap and not self.parts:
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def newline(self) -> None:
        """A forced line end."""
        self._open()
        self.lines.append("".join(self.parts))
        self.parts, self.space = [], False

    def block(self, gap: int) -> None:
        """The border of a block."""
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False
        self.gap = max(self.gap, gap)

    def insert(self, lines: list[str], gap: int) -> None:
        """Finished lines as a block."""
        if lines:
            self.block(gap)
            self._open()
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.block(1)
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        first = 0
        while first < len(lines) and not lines[first].strip():
            first += 1
        return lines[first:]


def render(node: Node, out: Lines, pre: bool = False) -> None:
    """The visible text of a node's children."""
    for child in node.children:
        if isinstance(child, str):
            (out.raw if pre else out.add)(child)
        elif visible(child):
            element(child, out, pre)


def element(node: Node, out: Lines, pre: bool) -> None:
    tag = node.tag
    gap = 2 if tag in MARGIN else 1
    if tag == "br":
        out.newline()
    elif tag == "wbr" or tag == "img":
        pass
    elif tag == "hr":
        out.insert(["---"], 2)
    elif tag == "table":
        out.insert(table(node), 2)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.insert(items(node, tag == "ol", pre), gap if tag in ("ul", "ol") else 1)
    elif tag in ("dd", "blockquote"):
        own = Lines()
        render(node, own, pre)
        out.insert([("  " if tag == "dd" else "> ") + x if x else x for x in own.done()], gap)
    elif tag == "details" and "open" not in node.attributes:
        out.block(1)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and visible(child):
                element(child, out, pre)
                break
        out.block(1)
    elif tag in BLOCK:
        out.block(gap)
        render(node, out, pre or tag == "pre")
        out.block(gap)
    else:
        render(node, out, pre)


def items(node: Node, ordered: bool, pre: bool) -> list[str]:
    """The lines of a list; what stands outside its items has no marker."""
    lines: list[str] = []
    number = _integer(node.attributes.get("start"), 1)
    for child in node.children:
        own = Lines()
        if isinstance(child, str):
            own.add(child)
        elif visible(child):
            if child.tag == "li":
                render(child, own, pre)
                number = _integer(child.attributes.get("value"), number)
                mark = f"{number}. " if ordered else "- "
                number += 1
                lines += [(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(own.done() or [""])]
                continue
            element(child, own, pre)
        lines += own.done()
    return [x.rstrip() for x in lines]


def _integer(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None and len(text) < 10 else default
    except ValueError:
        return default


def _rows(node: Node) -> Iterator[Node]:
    """The rows of a table in order; cells outside a row make one."""
    loose: list = []
    for child in node.children:
        if isinstance(child, Node) and not visible(child):
            continue
        if isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot"):
            if loose:
                row, loose = Node("tr"), []
                yield row
            if child.tag == "tr":
                yield child
            else:
                yield from _rows(child)
        elif isinstance(child, Node) and child.tag in ("td", "th"):
            if not loose:
                loose = [Node("tr")]
            loose[0].children.append(child)
    if loose:
        yield loose[0]


def _outside(node: Node) -> Iterator[Node | str]:
    """What stands in a table outside of its cells, in order, captions included."""
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif visible(child):
            if child.tag in PARTS:
                yield from _outside(child)
            elif child.tag not in ("td", "th", "col"):
                yield child


def table(node: Node) -> list[str]:
    """Caption and rows of a table, with aligned columns two spaces apart."""
    lines: list[str] = []
    for child in _outside(node):  # captions, and what browsers move in front of a table
        own = Lines()
        if isinstance(child, str):
            own.add(child)
        else:
            element(child, own, False)
        lines += own.done()
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still spans
    for row in _rows(node):
        cells: dict[int, tuple[list[str], int]] = {}
        below: dict[int, int] = {c: n - 1 for c, n in taken.items() if n > 1}
        at = 0
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not visible(cell):
                continue
            while at in taken:
                at += 1
            own = Lines()
            render(cell, own)
            wide = min(max(_integer(cell.attributes.get("colspan"), 1), 1), max(COLUMNS - at, 1))
            tall = _integer(cell.attributes.get("rowspan"), 1)
            cells[at] = own.done(), wide
            for c in range(at, at + wide):
                if tall > 1:
                    below[c] = tall - 1
            at += wide
        taken = below
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (text, wide) in cells.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), max(map(len, text), default=0))
    for cells in grid:  # a cell over several columns widens the last of them where it must
        for c, (text, wide) in cells.items():
            if wide > 1:
                have = sum(widths.get(k, 0) for k in range(c, c + wide)) + 2 * (wide - 1)
                widths[c + wide - 1] = widths.get(c + wide - 1, 0) + max(0, max(map(len, text), default=0) - have)
    columns = sorted(widths)
    starts, at = {}, 0
    for c in columns:
        starts[c] = at
        at += widths[c] + 2 if widths[c] else 0
    for cells in grid:
        for i in range(max((len(text) for text, _ in cells.values()), default=0)):
            line = ""
            for c, (text, _) in sorted(cells.items()):
                if i < len(text) and text[i]:
                    line = line.ljust(starts.get(c, len(line))) + text[i]
            lines.append(line.rstrip())
    return lines


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = Lines()
    render(parse(page), out)
    return "\n".join(x.rstrip() for x in out.done())


def with_text(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with their text as a last column ``name``, in place of any of this name."""
    pages = pages.drop(name) if name != html_col else pages
    prepared(pages.sparkSession)
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))
