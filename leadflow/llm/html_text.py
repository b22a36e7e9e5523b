"""HTML to text by layout: a tree with implied tags, visibility rules, and rendered blocks, lists and tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadflow.llm.common import values

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)  # a comment, or how a tag begins
UNFINISHED = re.compile(r"</?[a-zA-Z]")
PLAIN = re.compile(r"[^>\"']*")  # of a tag, up to its end or a quoted value
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = frozenset("script style head template noscript title meta link base object iframe audio video "
                   "canvas datalist desc metadata defs annotation annotation-xml".split())
BUTTONS = frozenset(("submit", "button", "reset"))  # inputs that show their value
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
                  "summary table ul caption tr tbody thead tfoot td th select optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu".split())
#: What a start tag closes, up to the element that stops the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "caption": ({"caption"}, {"table"}),
}
OPEN = 512  # open elements; a deeper one has its content in its parent, as in browsers
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "select", "optgroup", "option"}
#: What may stand in an open element; anything else, and text, ends it.
HOLDS = {
    "head": frozenset("base basefont bgsound link meta title noscript noframes script style template".split()),
    "colgroup": frozenset(("col", "template")),
}
ROWS = frozenset(("tbody", "thead", "tfoot"))
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
RULE = re.compile(r"([^{}]*)([{}])")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Node:
    """An element; children are nodes and strings. ``gone``: it has no box. ``shown``: text right in it is seen."""

    __slots__ = ("tag", "attributes", "children", "gone", "shown")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.gone, self.shown = False, True


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of a page: end tags that HTML implies are set, stray end tags are passed over, open elements end with the page."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(source)
    last = source.rfind(">")

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag in HOLDS and raw.strip(" \t\n\r\f"):
                stack.pop()
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while at < end:
        mark = source.find("<", at)
        if mark < 0:
            text(source[at:])
            break
        if mark > last and source[mark + 1 : mark + 2] not in ("!", "?"):  # no tag ends any more
            stop = source.find("<", mark + 1)
            stop = end if stop < 0 else stop
            text(source[at : mark if UNFINISHED.match(source, mark) else stop])
            at = stop
            continue
        m = MARK.match(source, mark)
        stop = _tag_end(source, m.end(), last) if m and m[2] else m.end() if m else 0
        if not m or stop < 0:  # a sign, or a tag that the page ends in: its markup is no text
            stop = source.find("<", mark + 1)
            stop = end if stop < 0 else stop
            text(source[at : mark if m else stop])
            at = stop
            continue
        text(source[at:mark])
        at = stop
        if not m[2]:
            continue
        tag, raw = m[2].lower(), source[m.end() : stop - 1]
        if m[1]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, _attributes(raw) if raw.strip(" /\n\t") else None)
        stack[-1].children.append(node)
        if raw.endswith("/") and any(x.tag in ("svg", "math") for x in stack):
            continue
        if tag == "form" and stack[-1].tag in ("table", "tr", *ROWS):
            continue  # stays empty there, as in browsers
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            held = source[at : stop.start() if stop else end]
            node.children.append(html.unescape(held) if tag == "textarea" else held)
            at = source.find(">", stop.end()) + 1 or end if stop else end
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "math")) and len(stack) < OPEN:
            stack.append(node)
    return root


def _tag_end(source: str, at: int, last: int) -> int:
    """Where a tag ends whose name ends at ``at``; -1 if the page ends first. ``last`` is the page's last ``>``.

    A quoted value may hold a ``>``; a quote that never ends holds nothing.
    """
    if at > last:
        return -1
    first = at
    while True:
        at = PLAIN.match(source, at).end()
        if at > last:
            return source.find(">", first) + 1
        if source[at] == ">":
            return at + 1
        stop = source.find(source[at], at + 1)
        if stop < 0 or stop > last:
            return source.find(">", first) + 1
        at = stop + 1


def _imply(stack: list[Node], tag: str) -> None:
    """Close what a start tag ends, and open the row that a cell needs."""
    if stack[-1].tag in HOLDS and tag not in HOLDS[stack[-1].tag]:
        stack.pop()
    if tag in ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in ("td", "th", "button", "table", "caption"):
                break
    if tag in CLOSES:
        ends, stops = CLOSES[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                break
            if stack[i].tag in stops:
                break
    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.append(row)


def _close(stack: list[Node], tag: str) -> None:
    """Close the nearest open element of the name; cells and rows don't end outside of their table."""
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    inner = tag not in ("table", "body", "html")
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if inner and stack[i].tag == "table":
            return


Rules = dict[str, list[tuple[int, set[str], dict[str, str]]]]  # by tag, class or id: place, all names, what is declared


def _style_rules(root: Node) -> Rules:
    """The display and visibility that a page's own style sheets declare for tags, classes and ids.

    Selectors of one element are read (``p``, ``.a``, ``p.a#b``); those of several, and what stands in an
    ``@`` block, such as styles for print, are passed over.
    """
    rules: Rules = {}
    number, todo = 0, [root]
    sheets = []
    while todo:
        x = todo.pop()
        if x.tag == "style":
            sheets.append("".join(c for c in x.children if isinstance(c, str)))
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    for sheet in sheets:
        selector, depth, at_block = "", 0, 0
        for held, brace in RULE.findall(COMMENT.sub(" ", sheet)):
            if brace == "{":
                depth += 1
                selector = held.rpartition(";")[2].strip()
                if selector.startswith("@") and not at_block:
                    at_block = depth
                continue
            if not at_block and depth == 1:
                declared = {k.lower(): v.lower() for k, v in DECLARED.findall(held)}
                for one in selector.split(",") if declared else []:
                    m = SELECTOR.fullmatch(one.strip())
                    if m and m[0]:
                        names = ({m[1].lower()} if m[1] else set()) | set(re.findall(r"[.#][\w-]+", m[2]))
                        number += 1
                        rules.setdefault(min(names, key=lambda x: x[0] in ".#"), []).append((number, names, declared))
            depth = max(depth - 1, 0)
            if at_block > depth:
                at_block = 0
    return rules


def _declared(node: Node, rules: Rules) -> dict[str, str]:
    """What applies to an element: later rules before earlier ones, its own style before all."""
    out: dict[str, str] = {}
    if rules:
        names = {node.tag, *(f".{c}" for c in node.attributes.get("class", "").split())}
        if node.attributes.get("id"):
            names.add(f"#{node.attributes['id']}")
        for _, wanted, declared in sorted((r for n in names for r in rules.get(n, ()) if r[1] <= names), key=lambda r: r[0]):
            out |= declared
    if "style" in node.attributes:
        out |= {k.lower(): v.lower() for k, v in DECLARED.findall(node.attributes["style"])}
    return out


def mark_seen(root: Node) -> None:
    """Set which elements have no box, and in which ones text is seen: visibility comes from the parent unless declared."""
    rules = _style_rules(root)
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, Node):
                continue
            own = _declared(c, rules) if rules or "style" in c.attributes else {}
            c.gone = (
                c.tag in UNSEEN or "hidden" in c.attributes or own.get("display") == "none"
                or c.attributes.get("type", "").lower() == "hidden" or c.tag == "dialog" and "open" not in c.attributes
            )
            seen = own.get("visibility")
            c.shown = seen not in ("hidden", "collapse") if seen and seen != "inherit" else node.shown
            if not c.gone:
                todo.append(c)


def visible(node: Node) -> bool:
    return not node.gone


BLANKS = re.compile(r"[ \t\n\r\f]+")


class _Page:
    """Lines under construction: text runs join within a line, blocks begin new lines, spaced blocks an empty one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line ends that are due before the next text
        self.bullet = ""
        self.indent = ""

    def write(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._put(first)
            for x in rest:
                self.end_line()
                self._put(x)
            return
        text = BLANKS.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.lstrip(" ")
        self._put(text)

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent + self.bullet)
            if self.bullet:
                self.indent += " " * len(self.bullet)
                self.bullet = ""
        self.line.append(text)

    def end_line(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif force and self.lines:
            self.lines.append("")
        self.gap = max(self.gap, 1)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


DEEPEST = 100  # tables within tables that are aligned; those below are rendered as blocks


def render(root: Node, depth: int = 0) -> str:
    """The visible text. Walks with a stack of its own, so that deep pages don't exhaust Python's."""
    page = _Page()
    # (node or string, keep blanks) to open; ("end", node, indent) to close
    todo: list[tuple] = [(root, False, None)]
    while todo:
        node, keep, closing = todo.pop()
        if closing is not None:
            page.block(node.tag in SPACED)
            page.indent, page.bullet = closing, ""
            continue
        if isinstance(node, str):
            page.write(node, keep)
            continue
        if not visible(node):
            continue
        tag = node.tag
        if tag == "br":
            page.end_line(force=True)
        elif tag == "img" or tag == "input":
            word = node.attributes.get("alt", "") if tag == "img" else ""
            if tag == "input" and node.attributes.get("type", "").lower() in BUTTONS:
                word = f" {node.attributes.get('value', '')} "
            if node.shown:
                page.write(word, False)
        elif tag == "textarea":
            if node.shown:
                page.write(f" {''.join(c for c in node.children if isinstance(c, str))} ", False)
        elif tag == "table" and depth < DEEPEST:
            page.block(True)
            for line in table_lines(node, depth + 1):
                page._put(line)
                page.end_line(force=not line)
            page.block(True)
        elif tag in BLOCK:
            page.block(tag in SPACED)
            before = page.indent
            if tag == "li":
                page.bullet = node.attributes.get("\0bullet", "- ")
            elif tag in ("dd", "blockquote"):
                page.indent += "  "
            if tag == "ol":
                _number(node)
            todo.append((node, keep, before))
            todo += [(c, keep or tag == "pre", None) for c in reversed(_seen(node))]
        else:
            todo += [(c, keep, None) for c in reversed(_seen(node))]
    return page.text()


def _seen(node: Node) -> list:
    """An element's children, without its text where that isn't seen."""
    return node.children if node.shown else [c for c in node.children if isinstance(c, Node)]


def _whole(text: str | None, other: int) -> int:
    """A whole number as HTML reads one."""
    m = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return int(m[1]) if m else other


def _number(items: Node) -> None:
    """Give the items of an ordered list their numbers: from the start on, down in a reversed list, anew from an item's value."""
    own = [c for c in items.children if isinstance(c, Node) and c.tag == "li" and visible(c)]
    step = -1 if "reversed" in items.attributes else 1
    number = _whole(items.attributes.get("start"), len(own) if step < 0 else 1)
    for item in own:
        number = _whole(item.attributes.get("value"), number)
        item.attributes["\0bullet"] = f"{number}. "
        number += step


def _rows(table: Node) -> Iterator[Node]:
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and visible(x):
            if x.tag == "tr":
                yield x
            elif x.tag in ("tbody", "thead", "tfoot"):
                todo += reversed(x.children)


def _loose(table: Node) -> Iterator[Node | str]:
    """What stands in a table, its row groups and its rows, but in no cell; that of a group or row as a block."""
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, Node) or x.tag not in ("tr", "colgroup", "col", *ROWS):
            yield x
        elif x.tag in ROWS and visible(x):
            own = Node("div")
            own.shown = x.shown
            own.children = [c for c in x.children if not isinstance(c, Node) or c.tag not in ("tr", *ROWS)]
            todo += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag in ("tr", *ROWS)]
            yield own
        elif x.tag == "tr" and visible(x):
            own = Node("div")
            own.shown = x.shown
            own.children = [c for c in x.children if not isinstance(c, Node) or c.tag not in ("td", "th")]
            if any(isinstance(c, Node) and c.tag in ("td", "th") and visible(c) for c in x.children):
                yield own


def _inner(node: Node, children: list, depth: int) -> str:
    """Children rendered for themselves, text among them as in ``node``."""
    inner = Node("#cell")
    inner.shown, inner.children = node.shown, children
    return render(inner, depth)


def _cell(cell: Node, depth: int) -> str:
    return BLANKS.sub(" ", _inner(cell, cell.children, depth)).strip()


PADDING = 20  # times its content that a table may grow by alignment; beyond it, cells stand side by side


def table_lines(table: Node, depth: int) -> list[str]:
    """A table's caption and other text first, then a line for each row, cells filled up to their column's width.

    Cells that span columns or rows take up as many, as far as other cells stand beside or below them; a table of
    one cell is layout and rendered as blocks.
    """
    out = [line for line in _inner(table, list(_loose(table)), depth).split("\n") if line]
    grid: list[dict[int, Node | str]] = []  # of each row the cells by the column that they begin in
    taken: dict[int, int] = {}  # up to which row a column is taken by a cell from above
    for row in _rows(table):
        cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]
        if not cells:
            other = _cell(row, depth)
            if other:
                grid.append({0: other})
            continue
        line: dict[int, Node | str] = {}
        at, here = 0, len(grid)
        for c in cells:
            while taken.get(at, 0) > here:
                at += 1
            line[at] = c
            wide = min(max(_whole(c.attributes.get("colspan"), 1), 1), 1_000)
            high = _whole(c.attributes.get("rowspan"), 1)
            if high != 1:
                taken.update(dict.fromkeys(range(at, at + wide), here + high if high > 1 else 1 << 31))
            at += wide
        grid.append(line)
    if len(grid) == 1 and len(grid[0]) == 1 and isinstance(grid[0].get(0), Node):
        only = grid[0][0]
        return out + _inner(only, only.children, depth).split("\n")
    columns = {x: i for i, x in enumerate(sorted({at for line in grid for at in line}))}
    lines = [{columns[at]: _cell(x, depth) if isinstance(x, Node) else x for at, x in line.items()} for line in grid]
    widths = [0] * len(columns)
    for line in lines:
        last = max(line)
        for i, x in line.items():
            if i < last:
                widths[i] = max(widths[i], len(x))
    upto = [0]
    for w in widths:
        upto.append(upto[-1] + w + 3)
    content = sum(len(x) + 3 for line in lines for x in line.values())
    aligned = sum(upto[max(line) + 1] for line in lines) <= PADDING * content + 1_000
    for line in lines:
        cells = [line.get(i, "").ljust(widths[i]) for i in range(max(line) + 1)] if aligned else line.values()
        joined = " | ".join(cells).rstrip()
        if joined.strip(" |"):
            out.append(joined)
    return out


def extract(source: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if source is None:
        return None
    root = parse(source)
    mark_seen(root)
    return render(root)


@F.arrow_udf(StringType())
def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([extract(x) for x in values(batch)], pa.string())


def text_column(source: str | Column = "html") -> Column:
    return _extract(source)


def extract_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``page_id, text`` of every row: one narrow pass, a page at a time.

    Null pages give null, empty pages and pages without visible text the empty text. Broken markup is
    read as far as it goes; a tag that the page ends in is no text. A very long page takes time in proportion to
    its length, and its text is bounded by its content. Repeated rows come back as often as they came.
    """
    return pages.select(F.col(id_col).alias("page_id"), text_column("html").alias("text"))
