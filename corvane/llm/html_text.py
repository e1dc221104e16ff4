"""Visible text of web pages, laid out.

A tokenizer feeds a tree builder that closes tags the way browsers imply (a block ends a paragraph, an item ends the
item before it, a cell ends a cell), up to a depth of DEPTH, as browsers have one; what is deeper hangs on the last level,
yet opens, hides and closes as before. Elements that are never shown, or hidden by attribute or inline style, are dropped; of drawings only
their text is shown. The rest is rendered: white space collapses, blocks
start on a line of their own with a blank line around paragraphs and their like, list items get a bullet or number and
an indent, table cells are padded to columns (over rows and columns that they span, and wrapped at CELL_WIDTH),
preformatted text stays as it is. A tag that no `>` ends is text. Time grows in proportion to a page's length.

Null html gives null text; empty html, and text without tags, are rendered as they are. Nothing raises on broken
markup. Repeated pages are rendered each, an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 512
#: Cells are wrapped at this width; a column is padded to WIDEST at most, where a word is as long as that.
CELL_WIDTH, WIDEST = 40, 120
# Element names by how they behave (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript noframes template title meta link base iframe object embed audio video canvas datalist area param source track".split())
RAW = frozenset("script style textarea title noscript noframes iframe template".split())
#: Elements that are never shown inside svg or math, ones that hold ordinary content there, and ones that end svg and math.
UNSEEN_IN = {"svg": frozenset("defs symbol clippath mask pattern marker metadata desc".split()), "math": frozenset(["annotation", "annotation-xml"])}
HOLDS_HTML = frozenset("foreignobject mi mo mn ms mtext".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CELLS = frozenset(["td", "th", "table"])
#: End tags that reach out of a cell.
OUTER = frozenset("tr td th table thead tbody tfoot body html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form hr article section main header footer nav aside address details".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr td th thead tbody tfoot caption summary figcaption legend center dir menu".split())
#: Starting one of these closes open ones of the set, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?=;|$)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NUMBER = re.compile(r"\s*(-?\d{1,9})")
_BLANK = re.compile(r"[ \t\r\n\f]+")


class Node:
    """hidden: with all it holds; shown: its own text is visible; space: svg, math, or drawn for text of a drawing."""

    __slots__ = ("children", "given", "hidden", "shown", "space", "tag")

    def __init__(self, tag: str, given: dict[str, str] | None = None, hidden: bool = False, shown: bool = True, space: str = ""):
        self.tag, self.given, self.hidden, self.shown, self.space, self.children = tag, given or {}, hidden, shown, space, []

    def number(self, name: str, least: int, most: int) -> int:
        """An attribute's number, 1 where there is none."""
        m = _NUMBER.match(self.given.get(name, ""))
        return min(most, max(least, int(m[1]))) if m else 1


def attributes(rest: str) -> dict[str, str]:
    """Names, in lower case, and values of a start tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hiding(given: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element is not displayed, and whether its text is visible; None as around it."""
    style: dict[str, tuple[bool, str]] = {}
    for m in _STYLE.finditer(_COMMENT.sub(" ", given.get("style", ""))):
        name, important = m[1].lower(), bool(m[3])
        if important or not style.get(name, (False, ""))[0]:
            style[name] = (important, m[2].lower())
    display = style["display"][1] if "display" in style else "none" if "hidden" in given else ""
    visibility = style.get("visibility", (False, ""))[1]
    return display == "none", {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(visibility)


class TagEnds:
    """Where tags end, outside of quotes, on pages where some don't: no stretch is looked through twice in vain."""

    def __init__(self, html: str):
        self.html, self.places = html, [m.start() for m in _SPECIAL.finditer(html)]
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def after(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`, or -1."""
        seen = []
        k = bisect_left(self.places, at)
        while k < len(self.places) and k not in self.dead:
            seen.append(k)
            place = self.places[k]
            quote = self.html[place]
            if quote == ">":
                return place
            if place >= self.last[quote]:
                break
            k = bisect_left(self.places, self.html.index(quote, place + 1)) + 1
        self.dead.update(seen)
        return -1


def _space(tag: str, parent: Node) -> str:
    if tag in ("svg", "math"):
        return tag
    if not parent.space or tag in HOLDS_HTML:
        return ""
    return "drawn" if tag == "text" and parent.space == "svg" else parent.space


def parse(html: str) -> Node:
    """The tree of a page, under a root of its own. Tags of html, head and body make no nodes: what a head may hold is never shown anyway, and what it can't hold ends it."""
    root = Node("html")
    stack, at, dim, ends = [root], 0, False, None
    places: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            places[node.tag].pop()
            if len(stack) >= DEPTH and node.tag in BLOCK:
                node.children.append(Node("div"))

    def text(s: str) -> None:
        top = stack[-1]
        if s and top.space != "svg":
            top.children.append(s if top.shown else " ")

    def close(tags: set[str], until: set[str]) -> None:
        while (k := last(tags)) > last(until):
            cut(k)

    said = 0  # what is before has become text or tags
    while m := _TOKEN.search(html, at):
        at = m.end()
        if m[2] is not None:
            whole = _REST.match(html, at) if ends is None else None
            if whole is None:
                ends = ends or TagEnds(html)
                close_at = ends.after(at)
                if close_at < 0:  # no tag
                    continue
                rest, at = html[at:close_at], close_at + 1
            else:
                rest, at = whole[1], whole.end()
        text(unescape(html[said : m.start()]))
        said = at
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            k = last((tag,))
            if k and (tag in OUTER or last(CELLS) <= k):  # other end tags don't reach out of a cell
                cut(k)
            continue
        if stack[-1].space and tag in LEAVES:
            while stack[-1].space:
                cut(len(stack) - 1)
        if tag in ("html", "head", "body"):
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK:
            close({"p"}, {"table", "td", "th", "li", "button", "dd"})
        if tag in ("td", "th") and stack[-1].tag not in ("tr",) and last(("table",)) and len(stack) < DEPTH:
            row = Node("tr", shown=stack[-1].shown)
            stack[-1].children.append(row)
            push(row)
        parent = stack[-1]
        space, given = _space(tag, parent), {}
        if rest and (tag in ("td", "th", "ol", "optgroup") or _MAY_HIDE.search(rest)):
            given = attributes(rest)
        unseen, visible = _hiding(given) if given else (False, None)
        unseen |= tag in UNSEEN or parent.space in UNSEEN_IN and tag in UNSEEN_IN[parent.space]
        node = Node(tag, given, unseen, parent.shown if visible is None else visible, space)
        dim |= not node.shown
        empty = rest.endswith("/") and (bool(parent.space) or space in ("svg", "math"))
        if tag in RAW:
            if not empty:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if tag == "textarea" and node.shown:
                    node.children.append(unescape(html[at : end.start() if end else len(html)]))
                at = said = end.end() if end else len(html)
            parent.children.append(node)
        elif tag in VOID or empty:
            parent.children.append(node)
        elif len(stack) < DEPTH:
            parent.children.append(node)
            push(node)
        else:  # too deep for a node: its text goes to the last level, or nowhere
            if not unseen:
                if tag in BLOCK:
                    parent.children.append(Node("div"))
                node.children = parent.children
            push(node)
        if tag == "optgroup" and node.shown and given.get("label"):
            node.children.append(given["label"])
    text(unescape(html[said:]))
    if dim:
        _prune(root)
    return root


def _prune(node: Node) -> bool:
    """Blanks in place of elements without visible text; whether any is left. Cells stay, for their columns."""
    kept, some = [], False
    for child in node.children:
        if isinstance(child, str):
            some |= node.shown and bool(child.strip())
        elif not child.hidden:
            left = _prune(child) or child.shown
            some |= left
            if not left and child.tag not in ("td", "th"):
                child = " "
        kept.append(child)
    node.children = kept
    return some


class Lines:
    """Lines under way: words join with single spaces, blocks ask for line breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def words(self, s: str) -> None:
        if not s:
            return
        flat = _BLANK.sub(" ", s)
        if flat == " ":
            self.space = True
            return
        if flat[0] == " ":
            self.space = True
        if self.gap:
            self._open()
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def _open(self) -> None:
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap, self.space = 0, False

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def raw(self, lines: list[str]) -> None:
        self.line()
        if lines:
            self._open()
            self.lines += lines

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _render(nodes: list, out: Lines, depth: int, keep: bool) -> None:
    for node in nodes:
        if isinstance(node, str):
            if keep:
                out.now.append(node)
            else:
                out.words(node)
            continue
        if node.hidden:
            continue
        tag = node.tag
        if tag == "br":
            if not out.now:
                out.now.append("")
            out.line()
        elif tag == "hr":
            out.block(2)
            out.raw(["---"])
            out.block(2)
        elif tag in ("pre", "textarea"):
            gap = 2 if tag == "pre" else 1
            out.block(gap)
            inner = Lines()
            _render(node.children, inner, depth, True)
            inner.line()
            out.raw([x.rstrip() for x in "\n".join(inner.lines).strip("\n").split("\n")] if inner.lines else [])
            out.block(gap)
        elif tag in ("option", "optgroup"):
            out.block(1)
            _render(node.children, out, depth, keep)
            out.block(1)
        elif tag == "mtd" or tag == "text" and node.space == "drawn":
            out.words(" ")
            _render(node.children, out, depth, keep)
            out.words(" ")
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(1 if depth else 2)
            number = node.number("start", -(10**9), 10**9) if tag == "ol" else 1
            for child in node.children:
                if isinstance(child, Node) and child.tag == "li" and not child.hidden:
                    inner = Lines()
                    _render(child.children, inner, depth + 1, keep)
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    rows = inner.done()
                    out.block(1)
                    out.raw([(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(rows)] if rows else [mark.rstrip()])
                else:
                    _render([child], out, depth, keep)
            out.block(1 if depth else 2)
        elif tag == "table":
            out.block(2)
            _table(node, out, depth)
            out.block(2)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            out.block(gap)
            if tag == "blockquote":
                inner = Lines()
                _render(node.children, inner, depth, keep)
                out.raw(["> " + x for x in inner.done()])
            else:
                _render(node.children, out, depth, keep)
            out.block(gap)
        else:
            _render(node.children, out, depth, keep)


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of CELL_WIDTH characters at most, but for longer words."""
    out = []
    for line in lines:
        if len(line) <= CELL_WIDTH:
            out.append(line)
            continue
        now: list[str] = []
        size = 0
        for word in line.split(" "):
            if now and size + len(word) > CELL_WIDTH:
                out.append(" ".join(now))
                now, size = [], 0
            now.append(word)
            size += len(word) + 1
        out.append(" ".join(now))
    return out


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node) and not child.hidden:
                if child.tag in tags:
                    return True
                todo.append(child)
    return False


def _table(table: Node, out: Lines, depth: int) -> None:
    rows: list[list[tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # rows that a cell above still takes of a column
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.words(node)
        elif node.hidden:
            continue
        elif node.tag in ("thead", "tbody", "tfoot"):
            held = {}
            todo += reversed(node.children)
        elif node.tag == "tr":
            cells, column, left = [], 0, {c: n - 1 for c, n in held.items() if n > 1}
            for cell in node.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th") and not cell.hidden:
                    while column in held:
                        cells.append(([""], 1))
                        column += 1
                    inner = Lines()
                    _render(cell.children, inner, depth, False)
                    lines, span, tall = inner.done() or [""], cell.number("colspan", 1, 1000), cell.number("rowspan", 0, 65534)
                    if max(map(len, lines)) > CELL_WIDTH and not _holds(cell, ("table", "pre", "textarea")):
                        lines = _wrapped(lines)
                    cells.append((lines, span))
                    if tall != 1:
                        left |= dict.fromkeys(range(column, column + span), tall - 1 if tall else 65534)
                    column += span
                else:
                    _render([cell], out, depth, False)
            rows.append(cells)
            held = left
        else:
            _render([node], out, depth, False)
            out.block(1)
    width: dict[int, int] = {}
    for cells in rows:
        column = 0
        for lines, span in cells:
            if span == 1:
                width[column] = min(WIDEST, max(width.get(column, 0), *(len(x) for x in lines)))
            column += span
    laid = []
    for cells in rows:
        for k in range(max((len(lines) for lines, _ in cells), default=0)):
            parts, column = [], 0
            for lines, span in cells:
                wide = sum(width.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(min(wide, WIDEST)))
                column += span
            laid.append(" | ".join(parts).rstrip())
    out.raw(laid)


def render(html: str) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * DEPTH + 1000))  # a nested table takes two calls a level
    out = Lines()
    _render(parse(html).children, out, 0, False)
    return "\n".join(x.rstrip() for x in out.done()).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_lines of each page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if h is None else render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(text, pa.string()), pa.array([None if t is None else len(t.split("\n")) if t else 0 for t in text], pa.int32())], names=["page_id", "text", "n_lines"])

    return pages.select(F.col("page_id").alias("page_id"), F.col("html").alias("html")).mapInArrow(extracted, "page_id long, text string, n_lines int")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text"))
