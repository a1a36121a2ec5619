"""Text of HTML pages as laid out: a tree with implied tags, visibility rules, and a renderer.

Method: a scanner feeds a tree builder that opens and closes elements as a browser would imply (a paragraph ends at a
block, a list item at the next one, rows and cells at theirs). What is not shown is left out: head, scripts, styles,
templates, comments, elements with ``hidden`` or styled ``display: none``, text styled ``visibility: hidden`` (inherited, until an
element within is ``visible``). A head without end tag ends at the first text or start tag that cannot be in it. The renderer walks the tree with a
stack of its own: paragraphs, headings, lists and tables stand apart by an empty line, other blocks by a line; items have
bullets or numbers and are indented by their depth (``MAX_INDENT`` levels at most); the cells of a table are padded to columns (to ``PAD``
places at most, wide characters taking two), also under cells over several rows and columns. A line break on an empty line leaves an empty
line; of a closed ``details`` only the summary is shown, of a closed ``dialog``, media and canvas nothing.

So that no layout blows up the output or the work: tables nested ``MAX_NEST`` deep are shown as blocks, columns beyond ``MAX_SPAN`` have cells
of one column, and cells over several rows hold their places in the first ``SPAN_COLUMNS`` columns only, and no gap is wider than ``MAX_GAP``.

Defined cases: null and empty pages give empty text; broken markup never fails, open elements end with the page, ends without a
start are ignored; repeated rows are rendered each; an empty table gives no rows; further columns are kept. Work is linear in
the page.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.tables import free_name, map_arrow

PAD, MAX_SPAN, SPAN_COLUMNS, MAX_NEST, MAX_INDENT, MAX_GAP = 60, 1000, 200, 8, 40, 200
#: Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title meta link iframe noembed noframes noscript object datalist audio video canvas".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir".split())
BLOCKS = APART | frozenset("html body div section article aside header footer nav main address form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend option center optgroup".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base link meta title style script noscript template noframes".split())
VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False}
#: A start tag ends open elements of the listed names, up to the nearest of the barriers.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption html button".split())

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAIL = re.compile(r"[\s/]*>?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
#: A declaration of a style; strings and parentheses may have semicolons.
_DECLARATION = re.compile(r"""(?:[^;"'(]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|\([^)]*(?:\)|\Z))+""", re.DOTALL)
_IMPORTANT = re.compile(r"\s*!\s*important\s*\Z")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def number(self, name: str, default: int) -> int:
        value = self.attributes.get(name, "").strip()
        return int(value) if re.fullmatch(r"-?[0-9]{1,6}", value) else default


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` and the place behind the tag's end."""
    out: dict[str, str] = {}
    while (found := _ATTRIBUTE.match(page, at)) is not None:
        value = found[2] or ""
        out.setdefault(found[1].lower(), entities.unescape(value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1 else value))
        at = found.end()
    return out, _TAIL.match(page, at).end()


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = [root]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, so that looking for an element costs nothing
    at, size = 0, len(page)

    def cut(i: int) -> None:
        for n in reversed(stack[i:]):
            opened[n.tag].pop()
        del stack[i:]

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened[n]), default=0)

    def close(names, barriers) -> None:
        outer = last(names)
        if outer > last(barriers):
            while outer > 1 and stack[outer - 1].tag in names:
                outer -= 1
            cut(outer)

    def text(value: str) -> None:
        if stack[-1].tag == "head" and value.strip(" \t\n\r\f"):
            cut(len(stack) - 1)
        if stack[-1].tag == "pre" and not stack[-1].children:
            value = value.removeprefix("\r").removeprefix("\n")
        if value:
            stack[-1].children.append(entities.unescape(value) if "&" in value else value)
    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            text(page[at:])
            break
        text(page[at : mark.start()])
        if mark[1]:  # a comment; it may be as short as <!-->
            end = page.find("-->", mark.end() - 2)
            at = size if end < 0 else end + 3
            continue
        if mark[4]:
            end = page.find(">", mark.end())
            at = size if end < 0 else end + 1
            continue
        tag = mark[3].lower()
        attributes, at = _attributes(page, mark.end())
        if mark[2]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body") and opened[tag]:
                if tag in SCOPE or tag in ("tr", "thead", "tbody", "tfoot") or opened[tag][-1] > last(SCOPE):
                    cut(opened[tag][-1])
            continue
        if tag == "html" or (tag == "body" and opened["body"]):
            continue
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        elif tag in BLOCKS:
            close({"p"}, SCOPE)
        if tag not in IN_HEAD and stack[-1].tag == "head":
            cut(len(stack) - 1)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            body = page[at : end.start() if end else size]
            if tag == "textarea":
                node.children.append(entities.unescape(body))
            elif tag == "xmp":
                node.children.append(body)
            at = page.find(">", end.end()) + 1 or size if end else size
        elif tag not in VOID:
            opened[tag].append(len(stack))
            stack.append(node)
    return root


class Flow:
    """Lines of running text with collapsed blanks and pending breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.apart = False  # an empty line is due before the next line
        self.empty = 0  # as many as line breaks on empty lines
        self.indent: list[str] = []
        self.bullet = ""

    def text(self, value: str) -> None:
        value = _BLANK.sub(" ", value)
        if value[:1] == " ":
            self.blank, value = True, value[1:]
        if not value:
            return
        trailing = value[-1] == " "
        if self.blank and self.parts:
            self.parts.append(" ")
        self.parts.append(value[:-1] if trailing else value)
        self.blank = trailing

    def line(self) -> None:
        """End the current line if it has text."""
        value = "".join(self.parts)
        if value:
            self.put(value)
        self.parts = []
        self.blank = False

    def put(self, value: str) -> None:
        if self.lines:
            self.lines += [""] * max(self.apart, self.empty)
        self.apart, self.empty = False, 0
        lead = "".join(self.indent[:MAX_INDENT])
        if self.bullet:
            lead, self.bullet = lead[: -len(self.bullet)] + self.bullet, ""
        self.lines.append(f"{lead}{value}".rstrip(" "))

    def gap(self) -> None:
        self.line()
        self.apart = True

    def result(self) -> str:
        self.line()
        return "\n".join(self.lines)


def style(node: Node) -> dict[str, str]:
    """``display`` and ``visibility`` of the style attribute; the last declaration holds, an important one before others."""
    value = node.attributes.get("style", "").lower()
    if "display" not in value and "visibility" not in value:
        return {}
    out: dict[str, str] = {}
    important = set()
    for declaration in _DECLARATION.findall(_NOTE.sub(" ", value)):
        name, _, setting = declaration.partition(":")
        name, strong = name.strip(), _IMPORTANT.search(setting)
        setting = (setting[: strong.start()] if strong else setting).strip()
        if name not in ("display", "visibility") or not setting or (name in important and not strong):
            continue
        if name == "visibility" and setting not in VISIBILITY and setting not in ("inherit", "unset", "revert"):
            continue
        out[name] = setting
        if strong:
            important.add(name)
    return out


def unseen(node: Node, styled: dict[str, str]) -> bool:
    closed = node.tag == "dialog" and "open" not in node.attributes
    return closed or node.tag in UNSEEN or "hidden" in node.attributes or styled.get("display") == "none"


def shown(node: Node) -> list[Node | str]:
    """The children that are rendered: of a closed ``details`` the first summary."""
    if node.tag != "details" or "open" in node.attributes:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


def width(text: str) -> int:
    """Places that a line takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Table:
    """Cells of a table as they come (text, columns, rows), and their layout."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []

    def places(self) -> list[list[tuple[list[str], int, int]]]:
        """(lines, first column, columns) of the cells of each row; cells from rows above keep their columns."""
        out, taken = [], {}  # column: the row where it is free again
        for number, row in enumerate(self.rows):
            at, placed = 0, []
            for cell, span, rows in row:
                while taken.get(at, 0) > number:
                    at += 1
                span = max(1, min(span, MAX_SPAN - at))
                if rows > 1:
                    for c in range(at, min(at + span, SPAN_COLUMNS)):
                        taken[c] = number + rows
                placed.append((cell.split("\n"), at, span))
                at += span
            out.append(placed)
        return out

    def lay_out(self) -> list[str]:
        placed = self.places()
        widths = [0] * max((at + span for row in placed for _, at, span in row), default=0)
        wanted = [[min(PAD, max(map(width, lines))) for lines, _, _ in row] for row in placed]
        for row, sizes in zip(placed, wanted, strict=True):
            for (_, at, span), w in zip(row, sizes, strict=True):
                if span == 1:
                    widths[at] = max(widths[at], w)
        for row, sizes in zip(placed, wanted, strict=True):  # a cell over several columns widens the last of them
            for (_, at, span), w in zip(row, sizes, strict=True):
                if span > 1 and w:
                    filled = [x for x in widths[at : at + span] if x]
                    missing = w - (sum(filled) + 2 * len(filled) - 2)
                    if missing > 0:
                        end = at + span - 1
                        widths[end] += missing if widths[end] else max(1, missing - 2)
        before = [0]
        for w in widths:
            before.append(before[-1] + w + (2 if w else 0))
        out = []
        for row in placed:
            for i in range(max((len(lines) for lines, _, _ in row), default=0) if any(lines != [""] for lines, _, _ in row) else 0):
                line, size = [], 0
                for lines, at, _ in row:
                    value = lines[i] if i < len(lines) else ""
                    if value:
                        gap = min(max(before[at] - size, 2 if size else 0), MAX_GAP)
                        line += [" " * gap, value]
                        size += gap + width(value)
                out.append("".join(line))
        return out


def render(root: Node) -> str:
    """Visible text of a tree, laid out."""
    flows, tables, lists, pre = [Flow()], [], [], 0
    visible = [True]  # of the open elements; text in an invisible one takes its place but is not shown
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, closing = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not visible[-1]:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                flow.parts.append(first)
                for part in rest:
                    flow.put("".join(flow.parts))
                    flow.parts = [part]
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not closing:
            styled = style(node)
            if unseen(node, styled):
                continue
            if tag == "br":
                if flow.parts:
                    flow.line()
                elif flow.lines:
                    flow.empty += 1
                continue
            if tag in APART and not (tag in ("ul", "ol") and lists and not flow.apart):
                flow.gap()
            elif tag in BLOCKS:
                flow.line()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", node.number("start", 1)])
            elif tag == "li":
                ordered = lists[-1][0] if lists else False
                if ordered:
                    lists[-1][1] = node.number("value", lists[-1][1])
                bullet = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
                flow.bullet = bullet
                flow.indent.append(" " * len(bullet))
            elif tag == "dd":
                flow.indent.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append(Table() if len(tables) < MAX_NEST else None)
            elif tag == "tr" and tables and tables[-1]:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                flows.append(Flow())
            visible.append(VISIBILITY.get(styled.get("visibility"), visible[-1]))
            work.append((node, True))
            work.extend((child, False) for child in reversed(shown(node)))
            continue
        visible.pop()
        if tag in ("td", "th") and tables and tables[-1]:
            cell = flows.pop().result()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((cell, max(1, node.number("colspan", 1)), max(1, node.number("rowspan", 1))))
            continue
        if tag == "li":
            flow.line()
            flow.bullet = ""
            flow.indent.pop()
        elif tag == "dd":
            flow.line()
            flow.indent.pop()
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "table":
            table = tables.pop()
            for x in table.lay_out() if table else ():
                flow.line()
                flow.put(x)
        if tag in APART and not (tag in ("ul", "ol") and lists):
            flow.gap()
        elif tag in BLOCKS:
            flow.line()
    return flows[0].result().strip("\n")


def extract(page: str) -> str:
    """Visible text of an HTML page."""
    return render(build(page)) if page else ""


def extract_column(pages: DataFrame, html: str = "html", text: str = "text", drop_html: bool = True) -> DataFrame:
    """``pages`` (without its HTML unless asked otherwise) and the laid-out text of each page."""
    place = pages.columns.index(html)
    kept = [i for i in range(len(pages.columns)) if i != place or not drop_html]
    names = [pages.columns[i] for i in kept]
    name = free_name(names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py() or "") for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], names=[*names, name])
    return map_arrow(pages, run, T.StructType([*(pages.schema[i] for i in kept), T.StructField(name, T.StringType())]))
