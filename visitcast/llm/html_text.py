"""HTML extraction: a tree builder and a layout-aware renderer.

``parse`` builds a tree: void elements, implied ``html``/``body`` free nesting,
implied end tags (``p``, ``li``, ``dt``/``dd``, ``option``, table parts), raw
text elements, comments and broken markup.  ``render`` emits all visible text:
hidden elements (by name, ``hidden``, inline style, a rule of a style sheet of
the page whose selector is a name, classes or an id without combinators, or a
dialog that is not open) are left out, white space collapses as in a browser,
blocks are set off by line breaks or blank lines, list items get a bullet or
their number, preformatted text keeps its space, and the cells of a table are
padded to aligned columns, ``colspan`` and ``rowspan`` included, line by line
(one below the other where padding would be far longer than the text).

Both work on a stack, never recursively, so depth is bounded by memory only.
A page is one row of one task: no shuffle, no group.

Defined results: null html gives null text, empty html empty text; a page
without tags is plain text; repeated rows are rendered alike; a null id stays
null; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

# Element names of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas "
                   "datalist input area annotation annotation-xml desc metadata".split())
# Of a drawing only these are shown as text, outside definitions.
DRAWN = frozenset({"text", "foreignobject"})
UNDRAWN = frozenset("defs symbol clippath mask marker pattern".split())
BLOCK = frozenset("address article aside blockquote body center details dd div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
                  "table tbody td tfoot th thead tr ul caption dialog option optgroup textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dt dd legend summary figcaption option "
                              "optgroup textarea".split())

# Opening a key ends the open elements of its value, up to a barrier.
IMPLIED_END: dict[str, frozenset[str]] = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "tbody": frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}),
    "thead": frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}),
    "tfoot": frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}),
}
BARRIER: dict[str, frozenset[str]] = {
    "li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}),
    "option": frozenset({"select", "datalist"}), "optgroup": frozenset({"select"}),
    **{k: frozenset({"table"}) for k in ("tr", "tbody", "thead", "tfoot")},
    "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"}),
}
# An end tag does not reach through these to an element outside.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template"})

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"
                  r"|/(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
                  r"|(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_BRACE = re.compile(r"[{}]")
_EVERY_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)|@layer\b[^{]*|@supports\b[^{]*", re.I)
_SELECTOR = re.compile(r"([A-Za-z][\w-]*|\*)?(?:[.#][\w-]+)*(?<=.)", re.S)
_PART = re.compile(r"[.#]?[\w-]+|\*")
_DECLARED = re.compile(r"(?:^|(?<=;))\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\x0b]+")


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)      # Node or str


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of a page; never fails on broken markup."""
    root = Node("#root")
    stack = [root]
    open_names: dict[str, int] = {}
    sheets: list[str] = []

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop().name] -= 1

    def close(names: frozenset[str], barrier: frozenset[str]) -> None:
        """Pop up to the outermost of ``names`` that no barrier shields."""
        if not any(open_names.get(n) for n in names):
            return
        cut = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in barrier:
                break
            if stack[depth].name in names:
                cut = depth
        if cut is not None:
            pop_to(cut)

    at = 0
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        tag = _TAG.match(source, lt)
        if tag is None:                                # a lone "<" is text
            stack[-1].children.append(html.unescape(source[at:lt]) + "<")
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(html.unescape(source[at:lt]))
        at = tag.end()
        if tag["cdata"] is not None:
            stack[-1].children.append(tag["cdata"])
        elif tag["end"]:
            name = tag["end"].lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif open_names.get(name):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        pop_to(depth)
                        break
                    if stack[depth].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
        elif tag["start"]:
            name = tag["start"].lower()
            if name in CLOSES_P:
                close(frozenset({"p"}), SCOPE)
            if name in IMPLIED_END:
                close(IMPLIED_END[name], BARRIER[name])
            node = Node(name, attributes(tag["attrs"]) if tag["attrs"] else {})
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                stop = end.start() if end else len(source)
                text = source[at:stop]
                node.children.append(html.unescape(text) if name in ("title", "textarea") else text)
                if name == "style" and not open_names.get("noscript") and not open_names.get("template"):
                    sheets.append(text)
                at = end.end() if end else len(source)
            elif name not in VOID and not (tag["attrs"] and tag["attrs"].rstrip().endswith("/") and foreign(open_names, name)):
                stack.append(node)
                open_names[name] = open_names.get(name, 0) + 1
    if sheets:
        hide_by_sheet(root, sheet_rules("\n".join(sheets)))
    return root


def foreign(open_names: dict[str, int], name: str) -> bool:
    """Inside a drawing or formula (or one itself), where ``/>`` ends an element."""
    return name in ("svg", "math") or bool((open_names.get("svg") or open_names.get("math"))
                                           and not open_names.get("foreignobject"))


def sheet_rules(css: str) -> dict[str, list[tuple]]:
    """Rules that set ``display`` or ``visibility``, by the name, ``.class`` or
    ``#id`` they are found by: (names needed, weight, property, hides)."""
    css = _COMMENT.sub("", css)
    out: dict[str, list[tuple]] = {}
    at = order = 0
    while (opening := css.find("{", at)) >= 0:
        head = css[at:opening].rpartition(";")[2].strip()
        if head.startswith("@"):
            if _EVERY_SCREEN.fullmatch(head):           # its rules count like any others
                at = opening + 1
                continue
            depth, end = 1, opening + 1
            while depth and (brace := _BRACE.search(css, end)):
                depth += 1 if brace[0] == "{" else -1
                end = brace.end()
            at = end if not depth else len(css)
            continue
        closing = css.find("}", opening)
        closing = len(css) if closing < 0 else closing
        found = declared(css[opening + 1:closing])
        for selector in head.lstrip("} \t\n\r\f").split(",") if found else ():
            order += 1
            if simple := _SELECTOR.fullmatch(selector.strip()):
                parts = _PART.findall(selector)
                needs = frozenset(simple[1].lower() if p == simple[1] else p for p in parts if p != "*")
                rank = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), len(parts))
                key = max(needs, key=lambda p: ((p[0] == "#") * 2 + (p[0] == "."), p), default="*")
                for prop, (hides, important) in found.items():
                    out.setdefault(key, []).append((needs, (important, rank, order), prop, hides))
        at = closing + 1
    return out


def declared(block: str) -> dict[str, tuple[bool, bool]]:
    """property -> (hides, important) of the declarations of a block."""
    out: dict[str, tuple[bool, bool]] = {}
    for prop, value, important in _DECLARED.findall(block):
        prop, hides = prop.lower(), value.lower() in ("none", "hidden", "collapse")
        if important or not out.get(prop, (False, False))[1]:
            out[prop] = (hides, bool(important))
    return out


def hide_by_sheet(root: Node, rules: dict[str, list[tuple]]) -> None:
    """Mark the elements that the rules hide; an element's own style goes
    before a rule that is not important."""
    todo: list = [root]
    while todo:
        node = todo.pop()
        todo.extend(c for c in node.children if isinstance(c, Node))
        own = {node.name, *("." + c for c in node.attrs.get("class", "").split())}
        if "id" in node.attrs:
            own.add("#" + node.attrs["id"])
        best: dict[str, tuple] = {}
        for key in (*own, "*"):
            for needs, weight, prop, hides in rules.get(key, ()):
                if needs <= own and weight > best.get(prop, ((-1,),))[0]:
                    best[prop] = (weight, hides)
        if best:
            for prop, (hides, important) in declared(node.attrs.get("style", "")).items():
                if important or not best.get(prop, ((False,),))[0][0]:
                    best[prop] = ((important,), hides)
            if any(hides for _, hides in best.values()):
                node.attrs["hidden"] = ""


def visible(node: Node) -> bool:
    if node.name in HIDDEN or "hidden" in node.attrs:
        return False
    if node.name == "dialog" and "open" not in node.attrs:
        return False
    return not (node.attrs and "style" in node.attrs and _INVISIBLE.search(node.attrs["style"]))


class Canvas:
    """Lines of text with collapsed space and pending line breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False                             # a collapsed space is due
        self.blank = False                             # a blank line is due
        self.prefix = ""                               # of the next line with text

    def words(self, text: str) -> None:
        found = _SPACE.split(text)
        for k, word in enumerate(found):
            if k:
                self.space = True
            if word:
                self.put(word)

    def put(self, text: str) -> None:
        if not self.parts:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            if self.prefix:
                self.parts.append(self.prefix)
                self.prefix = ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def line(self, force: bool = False) -> None:
        if self.parts or force:
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank = self.blank or spaced

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def display_width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_rows(node: Node) -> tuple[list[Node], list[list[Node]]]:
    """(captions, rows of cells) of a table; nested tables stay in their cell."""
    captions, rows, todo = [], [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, Node) and visible(child):
            if child.name == "caption":
                captions.append(child)
            elif child.name == "tr":
                rows.append([c for c in child.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)])
            elif child.name in ("td", "th"):
                rows.append([child])
            elif child.name != "table":
                todo.append(iter(child.children))
    return captions, rows


def spanned(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1


def placed(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """(first column, columns) of every cell, as ``colspan`` and ``rowspan`` lay
    them out; only columns in which a cell starts are counted."""
    laid, open_cells = [], []                           # cells from above: (first, end, row after the last)
    for r, row in enumerate(rows):
        open_cells = [c for c in open_cells if c[2] > r]
        taken, at, column, own = sorted(open_cells), 0, 0, []
        for cell in row:
            while at < len(taken) and taken[at][0] <= column:
                column = max(column, taken[at][1])
                at += 1
            end = column + max(1, spanned(cell, "colspan", 1000))
            down = spanned(cell, "rowspan", 65534)
            if down != 1:
                open_cells.append((column, end, r + down if down else len(rows)))
            own.append((column, end))
            column = end
        laid.append(own)
    starts = sorted({first for row in laid for first, _ in row})
    return [[(bisect_left(starts, first), bisect_left(starts, end) - bisect_left(starts, first)) for first, end in row]
            for row in laid]


def aligned(rows: list[list[tuple[int, int, str]]]) -> list[str]:
    """Lines of cells (first column, columns, text), padded to the widest of
    their columns, two spaces apart; a cell over several columns widens the last
    of them if it needs more room than they have."""
    cells = [[(at, n, text.split("\n")) for at, n, text in row] for row in rows]
    width = [0] * max((at + n for row in rows for at, n, _ in row), default=0)
    wide = []
    for row in cells:
        for at, n, lines in row:
            need = max(map(display_width, lines))
            if n == 1:
                width[at] = max(width[at], need)
            elif need:
                wide.append((n, at, need))
    for n, at, need in sorted(wide):
        width[at + n - 1] += max(0, need - sum(width[at:at + n]) - 2 * (n - 1))
    offset = [0, *accumulate(w + 2 for w in width)]
    out: list[str] = []
    for row in cells:
        height, text = max(len(lines) for _, _, lines in row), sum(len(line) for _, _, lines in row for line in lines)
        if height > 1 and height * offset[row[-1][0] + row[-1][1]] > 64 * text + 10_000:
            out.extend(line for _, _, lines in row if any(lines) for line in lines)
            continue
        for k in range(height):
            parts, used = [], 0
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    parts.append(" " * (offset[at] - used) + lines[k])
                    used = offset[at] + display_width(lines[k])
            out.append("".join(parts).rstrip())
    return out


def drawn(node: Node) -> list[Node]:
    """The elements of a drawing that show text."""
    out, todo = [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, Node) and child.name not in UNDRAWN and visible(child):
            if child.name in DRAWN:
                out.append(child)
            else:
                todo.append(iter(child.children))
    return out


def loose(node: Node) -> list:
    """Children of a table or its parts that stand outside all cells."""
    out, todo = [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if child.strip():
                out.append(child)
        elif child.name in ("tbody", "thead", "tfoot", "tr"):
            todo.append(iter(child.children))
        elif child.name not in ("td", "th", "caption", "colgroup", "col"):
            out.append(child)
    return out


def render(root: Node) -> str:
    """Visible text of a tree; one loop over an explicit stack of frames."""
    out = Canvas()
    # A frame is (kind, payload): nodes to enter, and what follows their children.
    stack: list[tuple[str, object]] = [("children", root)]
    canvases: list[Canvas] = []
    lists: list[int | None] = []
    pre = 0
    while stack:
        kind, x = stack.pop()
        if kind == "children":
            stack.extend(("node", c) for c in reversed(x.children))
        elif kind == "node" and isinstance(x, str):
            if pre:
                for k, part in enumerate(x.split("\n")):
                    if k:
                        out.line(force=True)
                    if part:
                        out.put(part)
            else:
                out.words(x)
        elif kind == "node":
            if not visible(x):
                continue
            name = x.name
            if name == "br":
                out.line(force=bool(out.parts) or bool(out.lines and out.lines[-1]))
            elif name == "hr":
                out.block(True)
            elif name == "img":
                if x.attrs.get("alt"):
                    out.words(x.attrs["alt"])
            elif name == "svg":
                for part in reversed(drawn(x)):
                    stack.append(("space", None))
                    stack.append(("node", part))
                stack.append(("space", None))
            elif name == "table":
                out.block(True)
                captions, rows = table_rows(x)
                grid: list[list[str]] = [[""] * len(r) for r in rows]
                stack.append(("grid", (grid, placed(rows))))
                for r in range(len(rows) - 1, -1, -1):
                    for c in range(len(rows[r]) - 1, -1, -1):
                        stack.append(("cell_end", (grid, r, c)))
                        stack.append(("children", rows[r][c]))
                        stack.append(("cell", None))
                for part in reversed([*captions, *loose(x)]):
                    stack.append(("line", None))
                    stack.append(("node", part))
            else:
                block = name in BLOCK
                if block:
                    out.block(name in SPACED and not (name in ("ul", "ol") and lists))
                if name in ("ul", "ol", "menu"):
                    first = x.attrs.get("start", "1")
                    lists.append(int(first) if name == "ol" and re.fullmatch(r"-?\d{1,9}", first) else
                                 1 if name == "ol" else None)
                elif name == "li":
                    mark = "- "
                    if lists and lists[-1] is not None:
                        mark = f"{lists[-1]}. "
                        lists[-1] += 1
                    out.prefix = "  " * max(len(lists) - 1, 0) + mark
                elif name in ("pre", "textarea"):
                    pre += 1
                elif name == "optgroup":
                    out.words(x.attrs.get("label", ""))
                    out.line()
                elif name == "q":
                    out.words('"')
                stack.append(("leave", x))
                stack.append(("children", x))
        elif kind == "leave":
            name = x.name
            if name in ("ul", "ol", "menu"):
                lists.pop()
            elif name == "li":
                out.line()
                out.prefix = ""
            elif name in ("pre", "textarea"):
                pre -= 1
            elif name == "q":
                out.words('"')
            if name in BLOCK:
                out.block(name in SPACED and not (name in ("ul", "ol") and lists))
        elif kind == "line":
            out.line()
        elif kind == "space":
            out.space = True
        elif kind == "cell":
            canvases.append(out)
            out = Canvas()
        elif kind == "cell_end":
            grid, r, c = x
            grid[r][c] = out.text()
            out = canvases.pop()
        elif kind == "grid":
            out.line()
            grid, places = x
            for row in aligned([[(*p, t) for p, t in zip(at, r)] for at, r in zip(places, grid) if any(r)]):
                if out.blank and out.lines:
                    out.lines.append("")
                out.blank = False
                out.lines.append(row)
            out.block(True)
    return out.text()


def page_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and visible text of every row."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):        # bounds the Python strings held at once
                part = b.slice(at, 64)
                texts = [page_text(s) for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")) \
        .mapInArrow(tidy(run), f"page_id {id_type}, text string")


def op4_html_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
