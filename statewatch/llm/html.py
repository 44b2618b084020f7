"""Visible text of web pages, laid out.

The project's records hold numbers and bits, no pages, so this operator is general: any table with an id and an HTML text.
A page becomes a tree (with the end tags that HTML leaves out), the tree is drawn on a canvas of lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import plain, slices

#: Fixed values of HTML: elements without content, with raw content, and those never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSED = frozenset("svg math g path rect circle ellipse line polygon polyline use text tspan stop mrow mspace".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript title iframe noembed noframes audio video canvas datalist link meta base param source track area"
    " defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split()
)
#: Blocks, and the empty lines around them.
MARGIN = (
    dict.fromkeys("address article aside body center dd details dialog dir div dt fieldset figcaption figure footer form header hgroup html legend li main menu nav optgroup option section summary tr tbody thead tfoot caption td th select".split(), 0)
    | dict.fromkeys("blockquote dl h1 h2 h3 h4 h5 h6 hr ol p pre table ul xmp".split(), 1)
)
#: A start tag ends an open element of these names, unless one of the walls comes first.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What ends an open paragraph, and what a paragraph can't be seen through.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul xmp".split())
P_WALLS = frozenset("td th table caption button html body template".split())
CELL_WALLS = frozenset("td th caption table html".split())
#: An element that may stand in the head doesn't end it.
IN_HEAD = frozenset("base link meta title script style noscript template html head".split())
TAG = re.compile(r"<(?=[A-Za-z/!?])")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
INSIDE = re.compile(r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z]+)", re.I)
#: Columns of a table are padded up to this width; what follows a wider cell in its row is moved on.
COLUMN = 60


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for found in ATTRIBUTE.finditer(self.attributes):
            if found[1].lower() == name:
                value = found[2] or ""
                return html.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        return None

    def styled(self) -> dict[str, str]:
        """The last ``display`` and ``visibility`` of the element's own style."""
        if not self.attributes or (style := self.attribute("style")) is None:
            return {}
        return {found[1].lower(): found[2].lower() for found in STYLE.finditer(style)}

    def shown(self) -> bool:
        """Whether the element and what it holds takes part in the page at all."""
        if self.tag in HIDDEN:
            return False
        if not self.attributes:
            return self.tag != "dialog"
        if self.attribute("hidden") is not None or (self.tag == "dialog" and self.attribute("open") is None):
            return False
        return self.styled().get("display") != "none"

    def seen(self, outside: bool) -> bool:
        """Whether the element's own text is seen, given that of the element around it: visibility is inherited and can be taken back."""
        own = self.styled().get("visibility") if self.attributes else None
        return outside if own in (None, "inherit", "unset", "revert") else own not in ("hidden", "collapse")


class Open:
    """The open elements, outermost first, with the places of each name, so that a look for one costs the same at any depth."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, index: int) -> None:
        while len(self.nodes) > index:
            self.places[self.nodes.pop().tag].pop()

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def find(self, names, walls) -> int:
        """Place of the innermost element of these names, 0 if there is none or a wall comes first."""
        found = self.last(names)
        return found if found > self.last(w for w in walls if w not in names) else 0


def parse(page: str) -> Node:
    """The tree of a page. Tags that are left out are implied, stray end tags are passed over, and whatever is open at the end is closed."""
    root = Node("html")
    opened = Open(root)
    stack, find, close = opened.nodes, opened.find, opened.close

    def text(start: int, stop: int) -> None:
        if stop > start:
            piece = page[start:stop]
            if stack[-1].tag == "head" and piece.strip():
                close(len(stack) - 1)
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if not found:
            text(at, n)
            break
        lt = found.start()
        nxt = page[lt + 1]
        if nxt in "!?":
            text(at, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        ending = nxt == "/"
        name = NAME.match(page, lt + 1 + ending)
        if not name:
            if ending:  # a bogus comment
                text(at, lt)
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text(at, lt + 1)
                at = lt + 1
            continue
        text(at, lt)
        inside = INSIDE.match(page, name.end())
        stop = inside.end()
        if stop >= n:  # no end in sight: the nearest one will do
            stop = page.find(">", name.end())
            stop = n if stop < 0 else stop
        attributes = page[name.end() : stop]
        at = stop + 1
        tag = name[0].lower()
        if ending:
            if tag == "p" and not find({"p"}, P_WALLS):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                walls = () if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else CELL_WALLS
                index = find({tag}, walls)
                if index:
                    close(index)
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in ENDS_P and (index := find({"p"}, P_WALLS)):
            close(index)
        if tag in CLOSES and (index := find(*CLOSES[tag])):
            close(index)
        if tag == "td" or tag == "th":
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                opened.push(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if tag in ("textarea", "xmp"):
                raw = page[at:stop]
                node.children.append(html.unescape(raw) if tag == "textarea" else raw)
            gt = page.find(">", stop)
            at = n if gt < 0 else gt + 1
            continue
        if not (stop > 0 and page[stop - 1] == "/" and tag in SELF_CLOSED):
            opened.push(node)
    return root


class Canvas:
    """Lines with pending white space, pending empty lines, and an indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.gap = 0
        self.indent = ""
        self.bullet: str | None = None

    def write(self, piece: str) -> None:
        piece = BLANKS.sub(" ", piece)
        if piece == " " or not piece:
            self.blank = self.blank or bool(piece)
            return
        if piece[0] == " ":
            self.blank = True
        if self.blank and self.line:
            self.line.append(" ")
        self.blank = piece[-1] == " "
        self.line.append(piece.strip(" "))

    def verbatim(self, piece: str) -> None:
        first, *rest = piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in rest:
            self.end_line(True)
            if part:
                self.line.append(part)

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            self.put("".join(self.line))
        self.line, self.blank = [], False

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        head = self.indent
        if self.bullet is not None:
            head, self.bullet = head[: len(head) - len(self.bullet)] + self.bullet, None
        self.lines.append((head + text).rstrip(" ") if text or head.strip() else "")

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Grid:
    """Rows of a table; cells are lists of lines."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column -> rows still covered from above
        self.column = 0

    def row(self) -> None:
        self.taken = {c: k - 1 for c, k in self.taken.items() if k > 1}
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        self.rows[-1].append((self.column, across, lines))
        if down > 1:
            for c in range(self.column, self.column + across):
                self.taken[c] = down
        self.column += across

    def draw(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    widths[column] = min(COLUMN, max(widths.get(column, 0), max(map(len, lines), default=0)))
        places, x = {}, 0
        for column in range(max((c + a for row in self.rows for c, a, _ in row), default=0)):
            places[column] = x
            x += widths.get(column, 0) + 2 * (widths.get(column, 0) > 0)
        out = []
        for row in self.rows:
            height = max((len(lines) for _, _, lines in row), default=0)
            for y in range(height):
                parts, length = [], 0
                for column, _, lines in row:
                    if y < len(lines) and lines[y]:
                        pad = places[column] - length
                        pad = max(pad, 2) if length else max(pad, 0)
                        parts.append(" " * pad + lines[y])
                        length += pad + len(lines[y])
                out.append("".join(parts).rstrip(" "))
        return out


def span(node: Node, name: str) -> int:
    found = re.match(r"\s*(\d{1,4})", node.attribute(name) or "")
    return max(1, min(1000, int(found[1]))) if found else 1


def render(root: Node) -> str:
    """All text that the page shows: blocks on lines of their own with their spacing, list items with marks and indents, table cells in columns."""
    canvas = Canvas()
    canvases: list[Canvas] = []
    grids: list[Grid] = []
    numbers: list[int | None] = []
    pre = 0
    seen = [True]  # of each open element
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            if grids and len(grids) > len(canvases) and not node.strip():
                continue  # white space between the parts of a table
            if not seen[-1]:
                canvas.write(" ")
                continue
            canvas.verbatim(node) if pre else canvas.write(node)
            continue
        tag = node.tag
        if not leaving:
            if not node.shown():
                continue
            if tag == "br":
                canvas.end_line(True)
                continue
            own = node.seen(seen[-1])
            if tag == "hr":
                canvas.block(1)
                if own:
                    canvas.put("---")
                    canvas.block(1)
                continue
            if tag == "input":
                if not own:
                    continue
                kind = (node.attribute("type") or "text").lower()
                if kind in ("text", "search", "submit", "reset", "button", "email", "url", "tel", "number") and (value := node.attribute("value")):
                    canvas.write(f" {value} ")
                continue
            if tag in VOID:
                continue
            children = node.children
            if tag == "details" and node.attribute("open") is None:  # closed: only its summary shows
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work.append((node, True))
            seen.append(own)
            work.extend((child, False) for child in reversed(children))
            if tag == "table":
                canvas.block(1)
                grids.append(Grid())
            elif tag == "tr" and len(grids) > len(canvases):
                grids[-1].row()
            elif tag in ("td", "th") and len(grids) > len(canvases):
                canvases.append(canvas)
                canvas = Canvas()
            elif tag in MARGIN:
                nested = tag in ("ul", "ol") and numbers
                canvas.block(0 if nested else MARGIN[tag])
                if tag in ("ul", "ol", "menu", "dir"):
                    start = node.attribute("start") if tag == "ol" else None
                    numbers.append((int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
                elif tag == "li":
                    number = numbers[-1] if numbers else None
                    if number is not None and (set_to := node.attribute("value")) and re.fullmatch(r"\s*-?\d{1,9}\s*", set_to):
                        number = int(set_to)
                    mark = "* " if number is None else f"{number}. "
                    if number is not None:
                        numbers[-1] = number + 1
                    node.attributes = mark  # remembered for leaving
                    canvas.indent += " " * len(mark)
                    canvas.bullet = mark if own else None
                elif tag in ("blockquote", "dd"):
                    canvas.indent += "    "
                elif tag in ("pre", "xmp"):
                    pre += 1
            elif tag == "textarea":
                pre += 1
            elif tag in ("svg", "text"):
                canvas.write(" ")
            continue
        seen.pop()
        if tag == "table":
            grid = grids.pop()
            canvas.end_line()
            for line in grid.draw():
                canvas.put(line)
            canvas.block(1)
        elif tag in ("td", "th") and canvases and len(grids) == len(canvases):
            lines = canvas.finish()
            canvas = canvases.pop()
            grids[-1].cell(lines, span(node, "colspan"), span(node, "rowspan"))
        elif tag in MARGIN and tag != "tr":
            if tag in ("pre", "xmp"):
                pre -= 1
            nested = False
            if tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()
                nested = tag in ("ul", "ol") and bool(numbers)
            canvas.block(0 if nested else MARGIN[tag])
            if tag == "li":
                canvas.indent = canvas.indent[: len(canvas.indent) - len(node.attributes)]
                canvas.bullet = None
            elif tag in ("blockquote", "dd"):
                canvas.indent = canvas.indent[:-4]
        elif tag == "textarea":
            pre -= 1
        elif tag in ("svg", "text"):
            canvas.write(" ")
    return "\n".join(canvas.finish())


def visible_text(page: str) -> str:
    return render(parse(page))


def extract_text(pages: DataFrame, id: str = "page_id", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id, text``.

    Text inside drawings and formulas is shown, without their titles, descriptions and definitions; an object shows what stands in for it. Columns of
    a table are padded to their widest cell of at most ``COLUMN`` characters; what follows a wider cell in its row is moved on.

    Cases: NULL or empty pages give an empty text. Broken markup is read as described at ``parse``, at any depth. Pages are read whole, whatever their length. Repeated rows give repeated results. An empty table gives no
    rows; other columns are not read.
    """
    schema = T.StructType([T.StructField("id", pages.schema[id].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(p) for p in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return pages.select(F.col(id).alias("id"), plain(page).alias("page")).mapInArrow(run, schema)
