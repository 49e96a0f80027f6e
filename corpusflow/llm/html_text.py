"""Operator 1: the visible text of HTML, laid out as a plain-text page.

A tree builder reads tags, adds the end tags that HTML lets authors leave out and
keeps elements that are not displayed out of the output.  The text of blocks is
set on lines of its own with blank lines where blocks have margins; list items are
numbered or marked and indented; table cells are padded to the width of their
column; white space collapses except in preformatted blocks.
"""

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct

#: Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist area base link meta param source track".split())
DRAWING = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
BLOCK = frozenset("html body address article aside blockquote center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu option optgroup dialog nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
#: An open element that a new element of this name ends, and the elements that stop the search for it.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
TEXT = T.StructType([T.StructField("content", T.StringType()), T.StructField("n_blocks", T.LongType())])


#: Elements that a table is made of, and for each that may stand in one what it is opened in.
TABLE = frozenset("table thead tbody tfoot tr td th caption colgroup col".split())
SECTIONS = frozenset("table thead tbody tfoot".split())
WITHIN = {"tr": SECTIONS, "td": frozenset(["tr"]) | SECTIONS, "th": frozenset(["tr"]) | SECTIONS, "thead": frozenset(["table"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"]), "caption": frozenset(["table"])}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag, attributes=None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(html: str) -> Node:
    """The element tree.  Wrong end tags are ignored; what is left open ends with the text."""
    root = Node("#root")
    stack = [root]
    depths: dict = {}  # of the open elements of each name
    at, size = 0, len(html)
    lowered = None

    def add_text(raw):
        if raw:
            stack[-1].children.append(raw)

    def push(node):
        depths.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(depth):
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def nearest(names):
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def end_open(names, stops):
        depth = nearest(names)
        if depth > nearest(stops):
            while depth - 1 > 0 and stack[depth - 1].tag in names:
                depth -= 1
            cut(depth)

    def to_table(name):
        """End what is open between a part of a table and where it belongs; a cell outside a row starts one."""
        depth = nearest(WITHIN[name])
        if depth and depth > nearest(("td", "th")):
            cut(depth + 1)
            if name in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            add_text(unescape(html[at:]))
            break
        if m.start() > at:
            add_text(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if depths.get(name):
                cut(depths[name][-1])
            continue
        if name in CLOSES_P:
            end_open(frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]))
        if name in ENDS:
            end_open(*ENDS[name])
        if name in WITHIN:
            to_table(name)
        node = Node(name, {a.lower(): unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else None)
        stack[-1].children.append(node)
        if name in RAW:
            if lowered is None:
                lowered = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            end = lowered.find(f"</{name}", at)
            close = html.find(">", end) if end >= 0 else -1
            raw = html[at : end if end >= 0 else size]
            node.children.append(unescape(raw) if name in ("textarea", "title") else raw)
            at = close + 1 if close >= 0 else size
        elif name not in VOID and not m[3].endswith("/"):
            push(node)
    return root


def shown(node: Node) -> bool:
    """Whether the element is displayed.  What needs a player or a plug-in shows its fallback, as in any rendering as text."""
    a = node.attributes
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return False
    return not (a and ("hidden" in a or UNSEEN.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden")))


def seen(node: Node, before: bool) -> bool:
    """Whether text in the element is visible: as its own style says, else as around it."""
    found = node.attributes and VISIBILITY.search(node.attributes.get("style", ""))
    return found[1].lower() == "visible" if found else before


def width_of(text: str) -> int:
    """Columns that a text fills: two for wide characters, none for marks that combine."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number_in(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1")
    return min(int(value), most) if value.isdecimal() and len(value) < 6 else 1


class Page:
    """Lines of output; ``gap`` is how many line ends must come before the next text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.blocks = [], [], 0, False, "", 0
        self.mark = None

    def text(self, raw: str, pre: bool):
        if pre:
            for k, part in enumerate(raw.split("\n")):
                if k:
                    self.end_line()
                if part:
                    self.put(part)
            return
        words = SPACE.split(raw)
        for k, word in enumerate(words):
            if k:
                self.space = True
            if word:
                self.put((" " if self.space and self.line else "") + word)
                self.space = False

    def put(self, piece: str):
        if not self.line:
            self.blocks += 1
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = self.indent
            if self.mark is not None:
                lead, self.mark = self.indent[: -len(self.mark)] + self.mark if self.mark else self.indent, None
            self.line.append(lead)
        self.line.append(piece)

    def end_line(self):
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, margin: bool):
        self.end_line()
        self.gap = max(self.gap, 2 if margin else 1)

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def strays(table: Node) -> list:
    """What stands in a table outside its cells and caption; browsers show it before the table."""
    out, todo = [], list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if SPACE.sub("", node):
                out.append(node)
        elif node.tag in ("tr", "thead", "tbody", "tfoot"):
            if shown(node):
                todo.extend(reversed(node.children))
        elif node.tag not in TABLE or node.tag == "table":
            out.append(node)
    return out


def table_lines(table: Node, visible: bool):
    """Rows of a table with each cell padded to its column's width; cells over several lines are joined.

    A generator: it yields what to render and is sent the text.  A cell over several
    rows or columns leaves empty cells in the others.
    """
    rows: list = []
    todo = [(c, visible) for c in reversed(table.children)]
    caption, held = [], {}  # held: rows that a column is still filled for
    while todo:
        node, visible = todo.pop()
        if isinstance(node, str) or not shown(node):
            continue
        visible = seen(node, visible)
        if node.tag == "tr":
            cells: list = []
            for cell in node.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th") and shown(cell):
                    while held.get(len(cells)):
                        held[len(cells)] -= 1
                        cells.append("")
                    text = (yield cell, seen(cell, visible))[0]
                    down = number_in(cell, "rowspan", 65534) - 1 if cell.attributes.get("rowspan") != "0" else 65534
                    for k in range(max(1, number_in(cell, "colspan", 1000))):
                        if down > 0:
                            held[len(cells)] = down
                        cells.append("" if k else " ".join(text.split()))
            for k in sorted(k for k, n in held.items() if n and k >= len(cells)):
                cells += [""] * (k + 1 - len(cells))
                held[k] -= 1
            if any(isinstance(c, Node) for c in node.children):
                rows.append(cells)
        elif node.tag == "caption":
            caption = [" ".join((yield node, visible)[0].split())]
        elif node.tag in SECTIONS and node.tag != "table":
            held = {}
            todo.extend((c, visible) for c in reversed(node.children))
    width: list = []
    for row in rows:
        width += [0] * (len(row) - len(width))
        for k, cell in enumerate(row):
            width[k] = max(width[k], width_of(cell))
    return [c for c in caption if c] + [" | ".join(c + " " * (w - width_of(c)) for c, w in zip(r, width)).rstrip() for r in rows if r]


def laid_out(root: Node) -> tuple:
    """The text and the number of its blocks.  Tables within cells wait on a stack of our own, so depth is bounded by memory alone."""
    waiting, answer = [flow(root, True)], None
    while True:
        try:
            node, visible = waiting[-1].send(answer)
        except StopIteration as done:
            waiting.pop()
            answer = done.value
            if not waiting:
                return answer
        else:
            waiting.append(flow(node, visible))
            answer = None


def flow(root: Node, visible: bool):
    """Lay out the content of one element; a generator that yields what is to be laid out by itself and is sent the result."""
    page = Page()
    # entries: a node or text to open, or a function to run when its content is done; then preformatted, visible, inside a drawing
    todo = [(c, False, visible, False) for c in reversed(root.children)]
    lists: list = []
    while todo:
        node, pre, visible, drawing = todo.pop()
        if callable(node):
            rest = node()
            if rest is not None:
                page.block(True)
                for line in (yield from rest):
                    page.put(line)
                    page.end_line()
                page.block(True)
            continue
        if isinstance(node, str):
            if visible and not drawing:
                page.text(node, pre)
            continue
        if not shown(node) or (drawing and node.tag in DRAWING):
            continue
        tag, visible = node.tag, seen(node, visible)
        if tag in ("svg", "text", "foreignobject"):
            drawing = tag == "svg"
        if tag == "br":
            page.end_line() if page.line else page.lines and page.lines[-1] and page.gap < 2 and page.block(False)
            continue
        if tag == "hr":
            page.block(True)
            continue
        if tag == "img":
            if visible and (alt := node.attributes.get("alt", "").strip()):
                page.text(alt, False)
            continue
        if tag == "table":
            page.block(True)
            todo.append((lambda table=node, visible=visible: table_lines(table, visible), pre, visible, drawing))
            todo.extend((c, pre, visible, drawing) for c in reversed(strays(node)))
            continue
        if tag not in BLOCK:
            pre = pre or tag == "textarea"
            todo.extend((c, pre, visible, drawing) for c in reversed(node.children))
            continue
        inner = tag in ("ul", "ol", "menu", "dir") and lists
        page.block(tag in MARGIN and not inner)
        before = page.indent
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.indent, page.mark = page.indent + " " * len(mark), mark
        elif tag in ("blockquote", "dd"):
            page.indent += "  "
        elif tag == "optgroup" and visible:
            page.text(node.attributes.get("label", ""), False)

        def close(tag=tag, before=before, inner=inner):
            page.block(tag in MARGIN and not inner)
            page.indent, page.mark = before, None
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()

        todo.append((close, pre, visible, drawing))
        todo.extend((c, pre or tag == "pre", visible, drawing) for c in reversed(node.children))
    return page.result(), page.blocks


def extract_text(html: str | None) -> dict:
    content, blocks = laid_out(parse(html)) if html else ("", 0)
    return {"content": content, "n_blocks": blocks}


def html_to_text(pages: DataFrame, html: str = "html", out: str = "rendered") -> DataFrame:
    """``pages`` and one struct column ``out``: content and n_blocks.

    A null or empty page has empty content.  Each row is rendered by itself, whole
    and without recursion, so depth and length of a page are bounded by memory
    alone; a column of the name ``out`` is replaced.
    """
    return append_struct(pages, html, out, TEXT, lambda: lambda texts: [extract_text(t) for t in texts], rows=200)
