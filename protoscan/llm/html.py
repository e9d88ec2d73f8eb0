"""Text of web pages by layout: a small tree builder, visibility rules and a block renderer.

A tokenizer (one regular expression) gives tags, comments and texts. The tree builder adds what HTML leaves
out: p, li, dt/dd, option and table parts end where the next one begins, a block ends an open p, an end
tag closes what is open inside it, and stray end tags are ignored. Scripts, styles and the like hold raw text. Nothing under
an invisible element is written: those of ``HIDDEN``, ``hidden`` and ``aria-hidden="true"`` attributes, and inline
styles ``display:none`` or ``visibility:hidden``. The renderer writes blocks on lines of their own, a blank line
around paragraphs, headings, lists and tables, bullets or numbers before list items, indented by depth, preformatted text as it is,
and table cells padded to the widest cell of their column.

All visible text is written, menus and footers too. Null and empty pages give an empty text. Broken markup never
fails: what is not a tag is text. Elements nest ``DEPTH`` deep at most; deeper ones become children of the element at this depth, so their
text is kept, and an invisible one there still hides all up to its end. Spark deals the pages out; there is no shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protoscan.llm.common import columns, fields, map_batches, others

DEPTH = 200
#: HTML's own limit.
COLSPAN = 1000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title meta link template noscript iframe object embed svg math canvas audio video datalist noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote menu dir figure".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "legend"}
#: A start tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
SCOPE = frozenset("table td th caption html button object".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[[^\]]*+\]\]>|<[!?][^<>]*+>|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<([a-zA-Z][^\s/<>]*+)", re.S)
REST = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+")
PLAIN = re.compile(r"[^<>\"']*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return entities.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None

    def visible(self) -> bool:
        if self.tag in HIDDEN:
            return False
        a = self.attributes
        if not a:
            return True
        lower = a.lower()
        if "hidden" in lower and (self.attribute("hidden") is not None or (self.attribute("aria-hidden") or "").strip().lower() == "true"):
            return False
        if self.tag == "input":
            return False
        return not ("style" in lower and INVISIBLE.search(self.attribute("style") or ""))


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """The place of the > that ends a start tag, or -1. ``failed``: quotes that led to none before, so each is followed once."""
    met = []
    while True:
        at = PLAIN.match(page, at).end()
        if page[at : at + 1] == ">":
            return at
        if page[at : at + 1] in ("", "<") or at in failed:
            break
        met.append(at)
        at = page.find(page[at], at + 1) + 1
        if not at:
            break
    failed.update(met)
    return -1


def _raw_end(page: str, tag: str, at: int) -> re.Match:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = [root]

    def close_to(names, barrier) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(entities.unescape(value) if "&" in value else value)

    begin = at = 0
    failed: set[int] | None = None
    swallowed: dict[str, int] | None = None  # open elements, by tag, of an invisible one that is too deep for the tree
    hider = ""
    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[begin:])
            return root
        at = m.end()
        end, start = m[1], m[2]
        attributes = ""
        if start:
            stop = REST.match(page, at).end() if failed is None else _tag_end(page, at, failed)
            if page[stop : stop + 1] != ">" or stop < 0:  # no tag, so text
                failed = set() if failed is None else failed
                continue
            attributes, at = page[at:stop], stop + 1
        if swallowed is None:
            text(page[begin : m.start()])
        begin = at
        if swallowed is not None:
            tag = (end or start or "").lower()
            if end and swallowed.get(tag):
                swallowed[tag] -= 1
                if tag == hider and not swallowed[tag]:
                    swallowed = None
                continue
            if end and any(n.tag == tag for n in stack) or start and swallowed[hider] == 1 and (hider in IMPLIED.get(tag, ((),))[0] or hider == "p" and tag in ENDS_P):
                swallowed = None  # what holds it ends, or what follows ends it
            else:
                if start and tag in RAW:
                    begin = at = _raw_end(page, tag, at).end()
                elif start and tag not in VOID:
                    swallowed[tag] = swallowed.get(tag, 0) + 1
                continue
        if end:
            end = end.lower()
            if end == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif end == "br":
                stack[-1].children.append(Node("br"))
            else:
                close_to({end}, {"table"} if end not in ("table", "html", "body") and end not in IMPLIED else set())
        elif start:
            tag = start.lower()
            if tag in ("html", "body") and len(stack) > 0 and any(n.tag == tag for n in stack):
                continue
            if tag in IMPLIED:
                close_to(*IMPLIED[tag])
            if tag in ENDS_P:
                close_to({"p"}, SCOPE)
            if tag == "body":
                close_to({"head"}, set())
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                closing = _raw_end(page, tag, at)
                value = page[at : closing.start()]
                if value:
                    node.children.append(entities.unescape(value) if tag in ("textarea", "title") else value)
                begin = at = closing.end()
            elif tag not in VOID and not node.attributes.rstrip().endswith("/") or tag in ("p", "div", "a", "li", "td") and tag not in VOID:
                if len(stack) < DEPTH:
                    stack.append(node)
                elif not node.visible():
                    swallowed, hider = {tag: 1}, tag
        elif m[0].startswith("<![CDATA["):
            text(m[0][9:-3].replace("&", "&amp;"))


class Writer:
    """Lines of text; keeps the blank lines between blocks to one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.lead = ""
        self.indent = ""

    def words(self, value: str) -> None:
        parts = SPACES.sub(" ", value)
        if not parts:
            return
        if parts[0] == " ":
            self.space = True
        body = parts.strip(" ")
        if not body:
            return
        if not self.line:
            self._open()
        elif self.space:
            self.line.append(" ")
        self.line.append(body)
        self.space = parts[-1] == " "

    def _open(self) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0
        self.line.append(self.indent + self.lead)
        if self.lead:
            self.indent += " " * len(self.lead)
            self.lead = ""
        self.space = False

    def end(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def exact(self, value: str) -> None:
        for i, line in enumerate(value.split("\n")):
            if i:
                self.end(1)
                if not line:
                    self.lines.append("")
            if line:
                if not self.line:
                    self._open()
                self.line.append(line.rstrip("\r"))

    def text(self) -> str:
        self.end(0)
        return "\n".join(self.lines).strip("\n")


def _rows(table: Node) -> list[Node]:
    rows = []
    for child in table.children:
        if isinstance(child, Node) and child.visible():
            if child.tag == "tr":
                rows.append(child)
            elif child.tag in ("tbody", "thead", "tfoot"):
                rows += _rows(child)
    return rows


def _table(node: Node, out: Writer) -> None:
    for child in node.children:  # what is not a row comes first: captions and misplaced text
        if isinstance(child, str):
            out.words(child)
        elif child.visible() and child.tag not in ("tr", "tbody", "thead", "tfoot", "colgroup", "col"):
            out.end(1)
            render(child, out)
            out.end(1)
    grid: list[dict[int, str]] = []  # the text of a row by column; columns without any text take no room
    for row in _rows(node):
        cells, column = {}, 0
        for child in row.children:
            if isinstance(child, str):
                value, span = " ".join(child.split()), 1
                if not value:
                    continue
            elif child.visible():
                inner = Writer()
                render(child, inner)
                wide = child.attribute("colspan") if child.attributes else None
                value, span = " ".join(inner.text().split()), min(int(wide), COLSPAN) if wide and wide.isdigit() and len(wide) < 10 and int(wide) else 1
            else:
                continue
            if value:
                cells[column] = value
            column += span
        if cells:
            grid.append(cells)
    used = sorted({c for cells in grid for c in cells})
    widths = {c: max((len(cells[c]) for cells in grid if c in cells and c != max(cells)), default=0) for c in used}
    for cells in grid:
        last = max(cells)
        out.end(1)
        out.exact("  ".join([cells.get(c, "").ljust(widths[c]) for c in used if c < last] + [cells[last]]))
        out.end(1)


def render(node: Node, out: Writer) -> None:
    """Writes the visible text below ``node``."""
    tag = node.tag
    numbers = 0
    if tag == "ol":
        first = node.attribute("start") if node.attributes else None
        numbers = int(first) if first and first.lstrip("-").isdigit() and len(first) < 10 else 1
    if tag == "table":
        _table(node, out)
        return
    for child in node.children:
        if isinstance(child, str):
            if tag in ("pre", "textarea", "xmp"):
                out.exact(child)
            else:
                out.words(child)
            continue
        if not child.visible():
            continue
        name = child.tag
        if name == "br":
            if out.line:
                out.end(0)
            else:
                out.gap = 2
        elif name == "img":
            out.words(child.attribute("alt") or "")
        elif name == "li":
            out.end(1)
            before, lead = out.indent, out.lead
            own = child.attribute("value") if child.attributes and tag == "ol" else None
            if own and own.isdigit() and len(own) < 10:
                numbers = int(own)
            out.lead = f"{numbers}. " if tag == "ol" else "- "
            out.indent = before + " " * len(lead)
            numbers += tag == "ol"
            render(child, out)
            out.end(1)
            out.indent, out.lead = before, ""
        elif name in BLOCKS:
            nested = name in ("ul", "ol", "menu", "dir") and tag == "li"
            gap = 2 if name in SPACED and not nested else 1
            out.end(gap)
            before = out.indent
            if name in ("blockquote", "dd"):
                out.indent += "  "
            render(child, out)
            out.end(gap)
            out.indent = before
        else:
            if name in ("button", "select", "label"):
                out.space = True
            render(child, out)


def page_text(page: str) -> str:
    out = Writer()
    render(parse(page), out)
    return out.text()


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the visible text, in place of the html column."""
    rest = others(pages, html.lower(), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [page_text(x or "") for x in batch.column("__html").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    return map_batches(pages.select(*columns(rest), F.coalesce(F.col(html), F.lit("")).alias("__html")), run, fields(pages, rest, "text string"), "__html")
