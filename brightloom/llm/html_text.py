"""HTML extraction by layout: a small tree builder with implied tags, then rendering of what is visible.

Blocks keep their spacing, list items their markers and nesting, and table cells
are padded so that columns line up. Pages are independent rows: Spark deals them
out, and each is rendered where it lies.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from brightloom.llm.common import numbered

BATCH_ROWS = 256


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _names("area base br col embed frame hr img input link meta param source track wbr")
RAW = _names("script style xmp iframe noembed noframes noscript title textarea")
UNSEEN = _names("head script style title template iframe noembed noframes noscript object audio video canvas datalist")
#: Elements of svg and math whose text a browser does not draw.
UNSEEN_INSIDE = {
    "svg": _names("defs title desc metadata symbol clippath mask pattern marker"),
    "math": _names("annotation annotation-xml mphantom"),
}
#: HTML goes on inside these elements of svg and math; other HTML elements end an open svg or math.
HTML_AGAIN = {"svg": _names("foreignobject title desc"), "math": _names("mi mo mn ms mtext")}
BREAK_OUT = _names(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var"
)
#: Parts of a drawing or formula that stand apart.
APART = {"svg": _names("text foreignobject"), "math": _names("mtr mtd mlabeledtr")}
#: Blocks set apart by a blank line, and blocks that only start a new line.
SPACED = _names("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir")
LINES = _names(
    "html body div section article header footer nav main aside address form li dt dd tr caption figcaption details"
    " summary legend option optgroup center dialog hgroup search thead tbody tfoot td th textarea"
)
BLOCKS = SPACED | LINES
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
#: start tag -> open elements it ends, unless one of the walls stands between.
ENDS = {
    "li": (_names("li"), _names("ul ol menu dir table td th")),
    "dt": (_names("dt dd"), _names("dl table td th")), "dd": (_names("dt dd"), _names("dl table td th")),
    "option": (_names("option"), _names("select datalist")), "optgroup": (_names("option optgroup"), _names("select")),
    "td": (_names("td th caption"), _names("table")), "th": (_names("td th caption"), _names("table")),
    "tr": (_names("tr td th caption"), _names("table")),
    **{s: (_names("thead tbody tfoot tr td th caption"), _names("table")) for s in ("thead", "tbody", "tfoot")},
    **{h: (HEADINGS, _names("table td th div section article")) for h in HEADINGS},
    "body": (_names("head"), frozenset()),
}
P_WALLS = _names("table td th caption button object foreignobject")
PHRASES_END_HEAD = BLOCKS - {"html", "head"} | _names("a b i em strong span img svg math")

_SPACE = re.compile(r"[ \t\n\r\f]+")
# A comment ends at once before > or ->, else at the first --> or --!>.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_START = re.compile(r"<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SHOWN_VALUES = _names("text submit button reset search email url tel number date time")


class Node:
    __slots__ = ("name", "attributes", "children", "space", "inside", "label")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None = None):
        self.name, self.attributes, self.children = name, attributes, []
        # "svg" or "math" for elements of those, else empty; the same for the children; whether svg draws text here.
        self.space = (parent.inside if parent else "") or (name if name in ("svg", "math") else "")
        self.inside = "" if name in HTML_AGAIN.get(self.space, ()) else self.space
        self.label = self.space == "svg" and (name == "text" or (parent.label if parent else False))


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value))
    return found


def build(html: str) -> Node:
    """The tree of a page. Missing end tags are implied, stray ones ignored; anything parses."""
    root = Node("#root", {})
    open_ = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of each name are

    def push(node: Node) -> None:
        places[node.name].append(len(open_))
        open_.append(node)

    def pop() -> None:
        places[open_.pop().name].pop()

    def close(names: frozenset[str], walls: frozenset[str], all_: bool = False) -> None:
        """End the innermost (or every) open element of ``names`` inside the nearest wall, with all that it holds."""
        held = [places[x] for x in names if places[x]]
        if not held:
            return
        stops = walls if names & {"svg"} else walls | {"foreignobject"}
        wall = max((places[x][-1] for x in stops if places[x]), default=0)
        if max(p[-1] for p in held) < wall:
            return
        cut = min(p[bisect_right(p, wall)] for p in held if p[-1] > wall) if all_ else max(p[-1] for p in held)
        while len(open_) > cut:
            pop()

    def break_out() -> None:
        while open_[-1].inside:
            pop()

    def start(name: str, raw: str) -> None:
        if open_[-1].inside:
            if name in BREAK_OUT:
                break_out()
            else:
                node = Node(name, _attributes(raw) if raw and not raw.isspace() else {}, open_[-1])
                open_[-1].children.append(node)
                if not raw.endswith("/"):
                    push(node)
                return
        if open_[-1].name == "head" and name in PHRASES_END_HEAD:
            pop()
        if name in BLOCKS and name not in ("html", "body"):
            close(_names("p"), P_WALLS)
        if name in ENDS:
            close(*ENDS[name], all_=True)
        if name in ("td", "th") and open_[-1].name in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            open_[-1].children.append(row)
            push(row)
        node = Node(name, _attributes(raw) if raw and not raw.isspace() else {}, open_[-1])
        open_[-1].children.append(node)
        if name not in VOID and not (node.space and raw.endswith("/")):
            push(node)

    at, n = 0, len(html)
    last = html.rfind(">")  # behind it no tag can end
    while at < n:
        left = html.find("<", at)
        if left < 0:
            left = n
        if left > at:
            open_[-1].children.append(unescape(html[at:left]))
        if left == n:
            break
        at = left
        nxt = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = _COMMENT_END.search(html, at + 4)
            at = end.end() if end else n
        elif open_[-1].inside and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            open_[-1].children.append(html[at + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        elif nxt == "/":
            end = html.find(">", at)
            name = html[at + 2 : n if end < 0 else end].split(None, 1)
            name = name[0].lower().rstrip("/") if name else ""
            at = n if end < 0 else end + 1
            if name in ("br", "p"):
                break_out()
            if name == "br":
                start("br", "")
            elif name == "p" and not places["p"]:
                start("p", "")
                pop()
            elif name:
                close(HEADINGS if name in HEADINGS else frozenset((name,)), frozenset() if name == "table" else _names("table"))
        elif at < last and (found := _START.match(html, at) or _LOOSE.match(html, at)):
            name = found[1].lower()
            at = found.end()
            start(name, found[2])
            if name in RAW and not open_[-1].space:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                inner = html[at : end.start() if end else n]
                open_[-1].children.append(unescape(inner) if name in ("title", "textarea") else inner)
                at = end.start() if end else n
        else:
            open_[-1].children.append("<")
            at += 1
    return root


class _Sink:
    """Lines under construction; blank lines between blocks collapse to the largest asked for."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = self.gap = False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line(empty=True)
                self._put(line)
            return
        if text[:1] in " \t\n\r\f" and text:
            self.space = self.space or bool(self.current)
        words = _SPACE.sub(" ", text).strip(" ")
        if words:
            if self.space:
                self.current.append(" ")
            self._put(words)
            self.space = text[-1] in " \t\n\r\f"

    def _put(self, text: str) -> None:
        if text:
            self.current.append(text)
            self.space = False

    def line(self, empty: bool = False) -> None:
        """End the line; an empty one counts only when asked for."""
        if self.current or (empty and (self.lines or not self.gap)):
            self._emit("".join(self.current).rstrip())
        self.current, self.space = [], False

    def _emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = self.gap or spaced

    def nested(self, lines: list[str], first: str, rest: str) -> None:
        self.line()
        for i, line in enumerate(lines):
            self._emit(((first if i == 0 else rest) + line).rstrip())

    def done(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = 0
        while start < len(lines) and not lines[start]:
            start += 1
        return lines[start:]


def _number(value: str | None, default: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(found[1]) if found else default


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, colspan, rowspan) padded to the width of their columns."""
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        placed, column, held = [], 0, dict(taken)
        for lines, across, down in row:
            while held.get(column, 0) > 0:
                column += 1
            placed.append((column, lines, across))
            if down > 1:
                for c in range(column, column + across):
                    taken[c] = down
            column += across
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        grid.append(placed)
    widths = [0] * max((c + across for row in grid for c, _, across in row), default=0)
    for wide in (False, True):
        for row in grid:
            for c, lines, across in row:
                need = max(map(len, lines), default=0)
                if wide == (across > 1):
                    have = sum(widths[c : c + across]) + 3 * (across - 1)
                    widths[c + across - 1] += max(0, need - have)
    out = []
    for row in grid:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            cells, at = [], 0
            for c, lines, across in row:
                cells += [" " * w for w in widths[at:c]]
                cells.append((lines[k] if k < len(lines) else "").ljust(sum(widths[c : c + across]) + 3 * (across - 1)))
                at = c + across
            out.append(" | ".join(cells).rstrip(" |" if not any(x.strip() for x in cells) else " "))
    return out


def _hidden(node: Node, shown: bool) -> tuple[bool, bool]:
    """(is the whole subtree gone, is its text shown)."""
    a = node.attributes
    if node.name in UNSEEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return True, shown
    if node.name == "input" and a.get("type", "").lower() == "hidden":
        return True, shown
    if node.space:
        if node.name in UNSEEN_INSIDE[node.space]:
            return True, shown
        if node.space == "svg" and a.get("display", "").strip() == "none":
            return True, shown
        if node.space == "svg" and a.get("visibility", "").strip() in ("visible", "hidden", "collapse"):
            shown = a["visibility"].strip() == "visible"
    style = re.sub(r"\s+", "", a.get("style", "")).lower()
    if style:
        if "display:none" in style or "content-visibility:hidden" in style:
            return True, shown
        if found := re.search(r"(?<![a-z-])visibility:([a-z]+)", style):
            shown = found[1] not in ("hidden", "collapse")
    return False, shown


def _drawn(node: Node) -> list:
    """The children of an element of svg or math that a browser draws."""
    children = node.children
    if node.space == "svg":
        if node.inside and not node.label:  # text outside <text> is not drawn
            children = [c for c in children if isinstance(c, Node)]
        if node.name == "switch":
            children = sorted((c for c in children if isinstance(c, Node)), key=lambda c: "systemlanguage" in c.attributes)[:1]
    elif node.name == "maction":
        children = [c for c in children if isinstance(c, Node)][:1]
    elif node.name == "mfrac":
        children = [x for c in children for x in (" ", c, " ")]
    return children


def render(root: Node) -> str:
    """All visible text of a tree. Works with a stack of its own, so depth does not matter."""
    sinks = [_Sink()]
    lists: list[list] = []  # [ordered, next number, step]
    tables: list[list] = []  # rows
    todo: list[tuple] = [(root, True, False, False)]  # node, text shown, white space kept, leaving
    while todo:
        node, shown, keep, leaving = todo.pop()
        if isinstance(node, str):
            if shown:
                sinks[-1].text(node, keep)
            continue
        name, a = node.name, node.attributes
        in_table = bool(tables)
        if leaving:
            if node.space:
                if shown and name in APART[node.space]:
                    sinks[-1].text(" ", False)
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                sinks[-1].block(not lists or lists[-1][0] is None)
            elif name == "li":
                lines, mark = sinks.pop().done(), "- "
                if lists and lists[-1][0]:
                    number = _number(a.get("value"), lists[-1][1])
                    mark, lists[-1][1] = f"{number}. ", number + lists[-1][2]
                if lines:
                    sinks[-1].nested(lines, mark, " " * len(mark))
            elif name in ("blockquote", "dd"):
                lines, mark = sinks.pop().done(), "> " if name == "blockquote" else "    "
                sinks[-1].nested(lines, mark, mark)
                sinks[-1].block(name == "blockquote")
            elif name in ("td", "th") and in_table:
                cell = (sinks.pop().done(), max(1, min(1000, _number(a.get("colspan"), 1))), max(1, _number(a.get("rowspan"), 1)))
                tables[-1][-1].append(cell)
            elif name == "table":
                lists.pop()
                sinks[-1].nested(_table(tables.pop()), "", "")
                sinks[-1].block(True)
            elif name in BLOCKS:
                sinks[-1].block(name in SPACED)
            continue
        gone, shown = _hidden(node, shown)
        if gone:
            continue
        children = node.children
        if name == "details" and "open" not in a:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if node.space:
            children = _drawn(node)
            if shown and name in APART[node.space]:
                sinks[-1].text(" ", False)
        if name == "br":
            sinks[-1].line(empty=True)
            continue
        if name == "input":
            if shown and a.get("type", "text").lower() in _SHOWN_VALUES and a.get("value"):
                sinks[-1].text(f" {a['value']} ", False)
            continue
        if name in BLOCKS and not (name in ("td", "th", "tr") and in_table):
            nested = name in ("ul", "ol", "menu", "dir") and bool(lists) and lists[-1][0] is not None
            sinks[-1].block(name in SPACED and not nested)
        if name in ("ul", "ol", "menu", "dir"):
            back = name == "ol" and "reversed" in a
            first = sum(isinstance(c, Node) and c.name == "li" for c in children) if back else 1
            lists.append([name == "ol", _number(a.get("start"), first), -1 if back else 1])
        elif name in ("li", "blockquote", "dd"):
            sinks.append(_Sink())
        elif name == "table":
            tables.append([])
            lists.append([None, 0, 0])  # a list inside a cell starts afresh
        elif name == "tr" and in_table:
            tables[-1].append([])
        elif name in ("td", "th") and in_table:
            if not tables[-1]:
                tables[-1].append([])
            sinks.append(_Sink())
        elif name in ("td", "th"):
            sinks[-1].text(" ", False)
        if name in VOID and not node.space:
            continue
        keep = keep or name in ("pre", "textarea", "xmp")
        todo.append((node, shown, keep, True))
        if keep and children and isinstance(children[0], str) and name in ("pre", "textarea"):
            children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
        todo += [(c, shown, keep, False) for c in reversed(children)]
    return "\n".join(sinks[0].done())


def visible_text(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``, the visible text of each whole page, to every row; existing columns of that name, in any case, are replaced.

    Null and empty pages give an empty text, and so does a page without visible
    text. Malformed markup never fails: it is read as a browser would, as far as
    text goes. Formulas and labels of drawings count as text; what an svg draws
    by ``use`` does not. What hides an element is its name, the attribute
    ``hidden`` or its own ``style``; rules of style sheets are not read.
    Repeated rows stay.
    """
    at = pages.columns.index(html)
    places = [i for i, c in enumerate(pages.columns) if c.lower() != text.lower()]
    schema = StructType([pages.schema.fields[i] for i in places]).add(text, "string")
    kept = [pages.columns[i] for i in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                made = pa.array([visible_text(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [made], [*kept, text])

    return numbered(pages).mapInArrow(run, schema)
