"""HTML extraction by layout-aware rendering.

A tokenizer reads tags, comments, declarations and raw-text elements; a tree builder supplies what authors leave out
(implied html, head, body, tbody and row elements, end tags that another tag implies, formatting elements closed with their
block); visibility rules drop what a reader never sees; a renderer then lays the tree out as text: inline white space
collapses, blocks stand on lines of their own, paragraphs are parted by a blank line, list items are marked and indented,
preformatted text is kept, and the cells of a table are aligned in columns.

Hidden are elements that browsers don't lay out, the hidden attribute, display:none, visibility:hidden or collapse in a style
attribute, and dialogs that aren't open; text hidden from screen readers alone is shown, and of a closed list the option that
it shows. Columns of a table in which no cell begins take no room, however wide a span is.

Null or empty HTML renders as the empty string, an empty table gives an empty result. Tags that never close, close twice or nest too deeply (over DEPTH, where
further elements are laid out in place) are no error. Rows are independent; repeated rows render alike; all input columns
pass through, one named like the output is replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.base import strings

DEPTH = 200
#: Fixed value: the widest span of columns in HTML.
WIDEST = 1000
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
HEAD = frozenset("base link meta script style title template noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object embed svg math canvas audio video datalist title meta link".split())
BLOCK = frozenset("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul caption tr tbody thead tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
#: Which open elements a start tag closes, up to the nearest of the elements that keep them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
P_CLOSERS = BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"} | {"li", "dd", "dt"}
SCOPE = frozenset("table td th caption html body button object".split())

TOKEN = re.compile(r"<(?:!--(?:-?>|(.*?)(?:--!?>|\Z))|(!|\?)[^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
WHITE = re.compile(r"[ \t\n\f\r]+")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name not in out:
            out[name] = html.unescape(m[2] or m[3] or m[4] or "")
    return out


class Builder:
    """The tree of a page."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.body: Node | None = None
        self.head: Node | None = None
        self.open = [self.root]

    def place(self) -> Node:
        """Where content goes: body is implied by the first content outside head."""
        if len(self.open) == 1:
            if self.body is None:
                self.body = Node("body", {})
                self.root.children.append(self.body)
            self.open.append(self.body)
        return self.open[-1]

    def text(self, data: str) -> None:
        if len(self.open) == 1 and not data.strip():
            return
        if self.open[-1] is self.head:
            if not data.strip():
                return
            self.open.pop()
        self.place().children.append(data)

    def pop_to(self, names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of those names, if no stop is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in stops:
                return

    def pop_all(self, names: set[str], stops: set[str]) -> None:
        """Close all open elements of those names below the nearest stop."""
        lowest = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in stops:
                break
            if self.open[k].name in names:
                lowest = k
        if lowest is not None:
            del self.open[lowest:]

    def start(self, name: str, given: dict[str, str], closed: bool) -> None:
        if name == "html":
            self.root.attributes = given | self.root.attributes
            return
        if name == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", given)
                self.root.children.append(self.head)
                self.open.append(self.head)
            return
        if name == "body":
            if self.body is None:
                del self.open[1:]
                self.place().attributes.update(given)
            else:
                self.body.attributes = given | self.body.attributes
            return
        if self.open[-1] is self.head and name not in HEAD:
            self.open.pop()
        if len(self.open) == 1 and name in HEAD and self.body is None:
            if self.head is None:
                self.head = Node("head", {})
                self.root.children.append(self.head)
            self.head.children.append(node := Node(name, given))
            if name not in VOID:
                self.open.append(node)
            return
        if name in P_CLOSERS:
            self.pop_to({"p"}, SCOPE)
        if name in CLOSES:
            self.pop_all(*CLOSES[name])
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        if name == "tr" and self.open[-1].name == "table":
            self.push(Node("tbody", {}))
        node = Node(name, given)
        if name in VOID or closed:
            self.place().children.append(node)
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        self.place().children.append(node)
        if len(self.open) < DEPTH:
            self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {}, True)
        elif name == "p" and not any(n.name == "p" for n in self.open):
            self.place().children.append(Node("p", {}))
        elif name in ("html", "body"):
            return
        elif name in BLOCK or name in ("td", "th"):
            stops = {"table"} if name not in ("table",) else set()
            if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table"):
                self.pop_to({name}, stops)
            else:
                self.pop_to({name}, {"td", "th", "caption", "table"})
        else:
            self.pop_to({name}, BLOCK | {"td", "th"})


def parse(page: str) -> Node:
    """The tree of a page, with html at its root."""
    builder, at = Builder(), 0
    low = None
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            builder.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            builder.text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[4] is None:
            continue
        name = m[4].lower()
        if m[3]:
            builder.end(name)
            continue
        given = attributes(m[5]) if m[5] and not m[5].isspace() else {}
        builder.start(name, given, m[5].endswith("/") and name not in BLOCK)
        if name in RAW:
            low = low if low is not None else page.lower()
            to = low.find("</" + name, at)
            raw = page[at : to if to >= 0 else len(page)]
            if name in ("textarea", "title"):
                raw = html.unescape(raw)
            if raw:
                builder.open[-1].children.append(raw)
            at = to if to >= 0 else len(page)
    return builder.root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.name == "input" or node.name == "dialog" and "open" not in a:
        return False
    return not ("style" in a and INVISIBLE.search(a["style"]))


def options(node: Node) -> list[Node]:
    out: list[Node] = []
    for x in node.children:
        if isinstance(x, Node) and visible(x):
            out += [x] if x.name == "option" else options(x)
    return out


def shown(select: Node) -> list[Node]:
    """The options of a closed list that a reader sees: those selected, else the first, where only one can be."""
    every = options(select)
    chosen = [x for x in every if "selected" in x.attributes]
    if "multiple" in select.attributes or number(select.attributes.get("size", ""), 1, 10**6) > 1:
        return every
    return chosen[-1:] or every[:1]


class Lines:
    """Text laid out so far: lines, a pending space, and how many blank lines are due."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.mark = ""
        self.indent = ""

    def inline(self, text: str) -> None:
        parts = WHITE.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = True
            if part:
                self.word(part)

    def word(self, text: str) -> None:
        if not self.now:
            self.begin()
        elif self.space and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def begin(self) -> None:
        if self.done:
            self.done += [""] * self.gap
        self.gap = 0
        self.now.append(self.indent + self.mark)
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def line(self) -> None:
        if self.now:
            self.done.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def lay(self, lines: list[str]) -> None:
        """Lines as they are."""
        self.line()
        for text in lines:
            self.begin()
            self.now.append(text)
            self.line()


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number(value: str, least: int, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", value)
    return max(least, min(most, int(m[1]))) if m else least


def rows_of(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of cells; heads first, feet last."""
    captions: list[Node] = []
    groups: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}

    def cells(row: Node) -> list[Node]:
        return [c for c in row.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)]

    for x in table.children:
        if not isinstance(x, Node) or not visible(x):
            continue
        if x.name == "caption":
            captions.append(x)
        elif x.name == "tr":
            groups["tbody"].append(cells(x))
        elif x.name in groups:
            groups[x.name] += [cells(r) for r in x.children if isinstance(r, Node) and r.name == "tr" and visible(r)]
    return captions, [r for g in groups.values() for r in g if r]


def strays(table: Node) -> list:
    """What a table holds outside its cells: it is laid out before the table."""
    out: list = []
    for x in table.children:
        if isinstance(x, str) or x.name not in ("caption", "colgroup", "col", "tr", "thead", "tbody", "tfoot"):
            out.append(x)
        elif x.name in ("tr", "thead", "tbody", "tfoot"):
            out += [y for y in (strays(x) if x.name != "tr" else [c for c in x.children if isinstance(c, str) or c.name not in ("td", "th")])]
    return [x for x in out if not isinstance(x, str) or x.strip()]


def render_table(table: Node, lines: Lines, depth: int) -> None:
    captions, rows = rows_of(table)
    for x in [*captions, *strays(table)]:
        render(x, lines, depth)
        lines.line()
    laid: list[list[tuple[int, list[str]]]] = []
    size: dict[int, int] = {}
    for row in places(rows):
        laid.append([])
        for c, cell in row:
            inner = Lines()
            for x in cell.children:
                render(x, inner, depth)
            inner.line()
            laid[-1].append((c, inner.done))
            size[c] = max(size.get(c, 0), max(map(width, inner.done), default=0))
    begins, total = {}, 0
    for c in sorted(size):
        begins[c] = total
        total += size[c] + 2
    out: list[str] = []
    for row in laid:
        for k in range(max((len(x) for _, x in row), default=0)):
            text, at = [], 0
            for c, x in row:
                if k < len(x) and x[k]:
                    text += [" " * (begins[c] - at), x[k]]
                    at = begins[c] + width(x[k])
            out.append("".join(text).rstrip())
    lines.lay(out)


def places(rows: list[list[Node]]) -> list[list[tuple[int, Node]]]:
    """Each row's cells with the columns in which they begin. Columns in which no cell begins take no room.

    What spans of rows above cover is kept as intervals, so that the widest and longest spans cost no more than others.
    """
    out = []
    over: list[tuple[int, int, int]] = []  # first column, the column after it, the row at which it ends
    for r, row in enumerate(rows):
        over = [x for x in over if x[2] > r]
        new, c, k = [], 0, 0
        out.append([])
        for cell in row:
            while k < len(over) and over[k][0] <= c:
                c = max(c, over[k][1])
                k += 1
            out[-1].append((c, cell))
            across, down = number(cell.attributes.get("colspan", ""), 1, WIDEST), cell.attributes.get("rowspan", "")
            down = len(rows) - r if down.strip() == "0" else number(down, 1, len(rows) - r)
            if down > 1:
                new.append((c, c + across, r + down))
            c += across
        if new:
            merged: list[tuple[int, int, int]] = []
            for x in sorted(over + new):
                if merged and merged[-1][1] == x[0] and merged[-1][2] == x[2]:
                    merged[-1] = (merged[-1][0], x[1], x[2])
                else:
                    merged.append(x)
            over = merged
    return out


def render(x: Node | str, lines: Lines, depth: int = 0, kept: bool = False) -> None:
    if isinstance(x, str):
        if kept:
            for k, part in enumerate(x.replace("\r\n", "\n").split("\n")):
                if k:
                    if not lines.now:
                        lines.begin()
                    lines.line()
                if part:
                    if not lines.now:
                        lines.begin()
                    lines.now.append(part)
        else:
            lines.inline(x)
        return
    if not visible(x) or depth > DEPTH + 50:
        return
    name = x.name
    if name == "br":
        if lines.now:
            lines.line()
        elif lines.done and lines.gap < 1:
            lines.gap = 1
        return
    if name == "img":
        if alt := x.attributes.get("alt", "").strip():
            lines.inline(alt)
        return
    if name == "wbr":
        return
    if name == "select":
        for k, x in enumerate(shown(x)):
            lines.inline(" " * (k > 0))
            for c in x.children:
                render(c, lines, depth + 1, kept)
        return
    if name not in BLOCK and name not in ("td", "th"):
        for c in x.children:
            render(c, lines, depth + 1, kept)
        return
    gap = 1 if name in SPACED else 0
    if name in ("ul", "ol", "menu", "dir") and lines.indent:
        gap = 0
    lines.block(gap)
    before = lines.indent
    if name == "hr":
        lines.lay(["---"])
    elif name == "table":
        render_table(x, lines, depth + 1)
    elif name in ("ul", "ol", "menu", "dir"):
        n = number(x.attributes.get("start", ""), 1, 10**6)
        for c in x.children:
            if isinstance(c, Node) and c.name == "li" and visible(c):
                n = number(c.attributes["value"], 0, 10**6) if "value" in c.attributes else n
                lines.line()
                lines.indent, lines.mark = before, (f"{n}. " if name == "ol" else "- ")
                for y in c.children:
                    render(y, lines, depth + 1)
                lines.line()
                lines.indent, lines.mark = before, ""
                n += 1
            else:
                lines.indent = before + "  "
                render(c, lines, depth + 1)
                lines.indent = before
    else:
        if name in ("blockquote", "dd"):
            lines.indent += "  "
        if name == "pre" and x.children and isinstance(x.children[0], str) and x.children[0].startswith("\n"):
            x.children[0] = x.children[0][1:]
        for c in x.children:
            render(c, lines, depth + 1, kept or name == "pre")
    lines.block(gap)
    if name not in ("li",):
        lines.indent = before


def text_of(page: str) -> str:
    """The visible text of a page."""
    lines = Lines()
    render(parse(page), lines)
    lines.line()
    return "\n".join(lines.done).strip("\n")


def title_of(page: str) -> str:
    """The title element's text."""
    for x in parse(page).children:
        if isinstance(x, Node) and x.name == "head":
            for y in x.children:
                if isinstance(y, Node) and y.name == "title":
                    return WHITE.sub(" ", "".join(c for c in y.children if isinstance(c, str))).strip()
    return ""


def extract(df: DataFrame, *, page: str = "html", to: str = "text", drop: bool = False) -> DataFrame:
    """df with the visible text of `page` as `to`; `drop` leaves the page out."""
    kept = [c for c in df.columns if c != to and not (drop and c == page)]
    read = list(dict.fromkeys([*kept, page]))
    schema = df.select(*kept).schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x) for x in strings(batch.column(page))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, to])

    return df.select(*read).mapInArrow(run, schema)
