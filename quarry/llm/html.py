"""HTML to text, as it is laid out.

A tree is built with implied tags (a paragraph ends where a block begins, items, cells
and rows end where the next begins, rows without a table body get one), and rendered:
hidden elements are left out; white space collapses but in <pre>; blocks stand on lines
of their own, with blank lines where browsers put margins; list items are marked and
indented; the cells of a table are aligned in columns.

Defined cases: null gives null, an empty text an empty text; unclosed comments, tags and
elements last to the end of the text. <details> counts as open. Rules of the page's own
<style> that name a tag, class or id hide and show elements as inline styles do; other
selectors, media rules and style sheets are not read. Columns are padded to any width, unless that
makes a table more than PADDED times as long as its page (then to the widest that doesn't);
indentation grows for DEEPEST levels of lists and quotes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

DEEPEST = 256
#: Characters that a table's padding may take: so many for each of the page, and LEAST_PADDED in any case.
PADDED, LEAST_PADDED = 64, 1 << 20
MOST_SPAN = 1000  # HTML's own limit of colspan

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas defs desc metadata annotation annotation-xml rp noframes noembed datalist".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())  # text up to their end tag
RAW_ESCAPED = frozenset("textarea title".split())
# Blocks with a margin, and blocks on lines of their own
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address details summary fieldset form legend figcaption li dt dd center hgroup dir listing xmp plaintext search option optgroup select textarea caption tr td th tbody thead tfoot".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup select textarea caption tr td th tbody thead tfoot legend".split())
# start tag: (open elements that it ends, elements beyond which it doesn't look)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}), "colgroup": ({"colgroup"}, {"table"}),
}
SCOPE = frozenset("table td th caption button html template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_TAG_END = re.compile(r"[\s/]*>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | RAW_ESCAPED}
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_LABELLED = frozenset("submit reset button".split())  # inputs whose value is shown
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, and the place after the tag."""
    out: dict[str, str] = {}
    while True:
        if m := _TAG_END.match(text, at):
            return out, m.end()
        m = _ATTRIBUTE.match(text, at)
        if not m:
            return out, text.find(">", at) + 1 or len(text)
        if (name := m[1].lower()) not in out:
            out[name] = m[2] or m[3] or m[4] or ""
        at = m.end()


class Builder:
    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.within: dict[str, list[int]] = {"html": [0]}  # places of the open elements by tag

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)

    def _pop(self) -> None:
        self.within[self.open.pop().tag].pop()

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.within.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _close(self, tags: set[str], bounds: frozenset[str] | set[str]) -> None:
        """End the nearest open element of these, if no bound stands before it."""
        last = lambda some: max((at[-1] for t in some if (at := self.within.get(t))), default=0)
        k = last(tags)
        if k and k >= last(bounds):
            while len(self.open) > k:
                self._pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if self.within.get("head"):
                self._close({"head"}, frozenset())
            if self.within.get(tag):
                return
        elif self.open[-1].tag == "head" and tag not in ("base", "link", "meta", "script", "style", "title", "template", "noscript", "basefont", "bgsound"):
            self._pop()
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._pop()
        if tag in ENDS:
            self._close(*ENDS[tag])
            top = self.open[-1].tag
            if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", {})
            elif tag == "tr" and top == "table":
                self._push("tbody", {})
        self._push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.within.get("p"):
            self._push(tag, {})
            if tag == "p":
                self._pop()
        elif tag in HEADINGS:
            self._close(set(HEADINGS), SCOPE)
        elif tag not in ("html", "body"):
            table = tag in ("table", "tr", "tbody", "thead", "tfoot")
            self._close({tag}, frozenset(("table",)) if table else SCOPE - {tag})


def parse(text: str) -> Node:
    b, at, size = Builder(), 0, len(text)
    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            part = text[at:lt]
            b.text(unescape(part) if "&" in part else part)
        if lt >= size:
            break
        at = lt
        follows = text[at + 1 : at + 2]
        if follows == "!" and text.startswith("<!--", at):
            end = at + 5 if text.startswith("<!-->", at) else text.find("-->", at + 4)
            at = size if end < 0 else end if text.startswith("<!-->", at) else end + 3
        elif follows in ("!", "?"):
            at = text.find(">", at) + 1 or size
        elif follows == "/":
            m = _NAME.match(text, at + 2)
            at = text.find(">", at) + 1 or size
            if m:
                b.end(m[0].lower())
        elif m := _NAME.match(text, at + 1):
            tag = m[0].lower()
            attributes, at = _attributes(text, m.end())
            b.start(tag, attributes)
            if tag in _RAW_END:
                inner = b.open[-1]
                end = _RAW_END[tag].search(text, at)
                stop = end.start() if end else size
                inner.children.append(unescape(text[at:stop]) if tag in RAW_ESCAPED else text[at:stop])
                at = (text.find(">", stop) + 1 or size) if end else size
                b.end(tag)
        else:
            b.text("<")
            at += 1
    return b.root


def hidden(node: Node) -> bool:
    a, tag = node.attributes, node.tag
    if tag in HIDDEN or tag == "dialog" and "open" not in a or tag == "input" and (a.get("type", "").strip().lower() not in _LABELLED or not a.get("value")):
        return True
    return bool(a) and ("hidden" in a or "style" in a and bool(_UNSEEN.search(a["style"])))


def _blank_invisible(root: Node) -> None:
    """Take out the text of elements that `visibility` hides; it is inherited, and an element inside may be visible again."""
    stack = [(root, True)]
    while stack:
        node, seen = stack.pop()
        if m := _VISIBILITY.search(node.attributes.get("style", "")):
            seen = m[1].lower() == "visible"
        if not seen:
            node.children = [x for x in node.children if isinstance(x, Node)]
            if node.tag == "input":
                node.attributes.pop("value", None)
        stack += [(x, seen) for x in node.children if isinstance(x, Node)]


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}?)")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}?")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SHOWN = {"display": re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I), "visibility": re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)}


def style_rules(css: str) -> list[tuple[tuple[int, int, int], str | None, frozenset[str], frozenset[str], dict[str, str]]]:
    """(weight, tag, ids, classes, declarations) of the rules that show or hide what a tag, ids and classes name."""
    out = []
    for selectors, body in _RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", css))):
        told = {k: found[-1].lower() for k, x in _SHOWN.items() if (found := x.findall(body))}
        for one in selectors.split(",") if told else ():
            m = _SELECTOR.fullmatch(one.strip())
            if m and m[0]:
                names = re.findall(r"[.#][\w-]+", m[2])
                ids, classes = (frozenset(x[1:] for x in names if x[0] == sign) for sign in "#.")
                tag = None if m[1] in (None, "*") else m[1].lower()
                out.append(((len(ids), len(classes), int(tag is not None)), tag, ids, classes, told))
    return sorted(out, key=lambda r: r[0])  # of equal weights the later rule wins


def _apply_styles(root: Node) -> None:
    """Write what the page's rules say into the elements' own styles, which go before them."""
    css, every, stack = [], [], [root]
    while stack:
        node = stack.pop()
        every.append(node)
        if node.tag == "style":
            css.append("".join(x for x in node.children if isinstance(x, str)))
        stack += [x for x in reversed(node.children) if isinstance(x, Node)]
    rules = style_rules("\n".join(css))
    if not any(r[4].get("display") == "none" or "visibility" in r[4] for r in rules):
        return
    for node in every:
        a, told = node.attributes, {}
        mine = frozenset(a.get("class", "").split())
        for _, tag, ids, classes, declared in rules:
            if (tag is None or tag == node.tag) and ids <= {a.get("id", "")} and classes <= mine:
                told |= declared
        own = a.get("style", "")
        more = [f"{k}:{v}" for k, v in told.items() if not _SHOWN[k].search(own)]
        if more:
            a["style"] = ";".join([*more, own])


class Layout:
    """Lines of text; breaks and margins are kept until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0  # blank lines wanted before the next line
        self.lead: list[str] = []  # prefixes of the open blocks; used once, then blanks

    def break_line(self) -> None:
        if self.parts:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = "".join(self.lead)
            self.lead = [" " * len(x) for x in self.lead]
            self.lines.append((lead + "".join(self.parts)).rstrip())
            self.parts = []
        self.space = False

    def margin(self) -> None:
        self.break_line()
        self.gap = 1

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
        if body := words.strip(" "):
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = words[-1] == " "

    def exact(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.parts.append("")
                self.break_line()
            if line:
                self.parts.append(line)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(MOST_SPAN, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def _rows(table: Node) -> tuple[list[Node], list[Node]]:
    """The rows of a table in the order shown (head first, foot last), and what else it holds."""
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    rest: list = []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                rest.append(child)
        elif hidden(child):
            continue
        elif child.tag in parts:
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr":
                    if not hidden(row):
                        parts[child.tag].append(row)
                elif isinstance(row, Node) or row.strip():
                    rest.append(row)
        elif child.tag == "tr":
            parts["tbody"].append(child)
        elif child.tag not in ("col", "colgroup"):
            rest.append(child)
    return parts["thead"] + parts["tbody"] + parts["tfoot"], rest


def _padded(widths: dict[int, int], rows: int, most: int) -> dict[int, int]:
    """The widths, cut to the widest for which rows of them stay below so many characters."""
    widest = max(widths.values(), default=0)
    while widest and rows * sum(min(w, widest) for w in widths.values()) > most:
        widest //= 2
    return {k: min(w, widest) for k, w in widths.items()}


def _table(table: Node, out: Layout, most: int) -> None:
    rows, rest = _rows(table)
    for node in rest:  # captions, and what stands outside of cells
        _render(node if isinstance(node, Node) else _holder(node), out, most)
        out.break_line()
    grid: list[list[list[str]]] = []
    held: dict[int, int] = {}  # columns that a cell above still fills, with the rows left
    widths: dict[int, int] = {}
    for row in rows:
        cells: dict[int, list[str]] = {}
        at = 0
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and hidden(cell):
                continue
            while held.get(at):
                at += 1
            inner = Layout()
            _render(cell if isinstance(cell, Node) else _holder(cell), inner, most)
            inner.break_line()
            cells[at] = inner.lines
            wide, tall = (_span(cell, "colspan"), _span(cell, "rowspan")) if isinstance(cell, Node) else (1, 1)
            if wide == 1:
                widths[at] = max(widths.get(at, 0), max(map(_width, inner.lines), default=0))
            for k in range(at, at + wide):
                if tall > 1:
                    held[k] = tall
            at += wide
        held = {k: n - 1 for k, n in held.items() if n > 1}
        grid.append([cells.get(k, []) for k in range(max(cells, default=-1) + 1)])
    widths = _padded(widths, sum(max(map(len, row), default=0) for row in grid), most)
    for row in grid:
        for k in range(max(map(len, row), default=0)):
            line = [c[k] if k < len(c) else "" for c in row]
            text = "  ".join(x + " " * (widths.get(i, 0) - _width(x)) for i, x in enumerate(line)).rstrip()
            if text:
                out.parts.append(text)
                out.break_line()


def _holder(text: str) -> Node:
    node = Node("span", {})
    node.children.append(text)
    return node


def _number(node: Node, name: str) -> int | None:
    value = node.attributes.get(name, "").strip()
    return int(value) if re.fullmatch(r"[+-]?[0-9]{1,9}", value) else None


def _numbering(node: Node) -> list[int] | None:
    """The next number and the step of a list, None for one without numbers."""
    if node.tag != "ol":
        return None
    back, start = "reversed" in node.attributes, _number(node, "start")
    items = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if back and start is None else 1
    return [items if start is None else start, -1 if back else 1]


def _render(top: Node, out: Layout, most: int) -> None:
    """Lay out a node; only tables within tables call this again. most: characters that a table's padding may take."""
    numbers: list[list[int] | None] = []
    stack: list[tuple[Node, Iterator, bool]] = []

    def enter(node: Node) -> None:
        tag = node.tag
        if tag == "input":
            out.text(node.attributes["value"])
        if tag == "br":
            out.parts.append("")
            out.break_line()
        if tag in SPACED and not (tag in ("ul", "ol") and numbers):
            out.margin()
        elif tag in BLOCK:
            out.break_line()
        if tag in ("ul", "ol", "menu", "dir"):
            numbers.append(_numbering(node))
            out.lead.append("  " if len(numbers) > 1 and len(out.lead) < DEEPEST else "")
        elif tag == "li":
            mark = "- "
            if numbers and numbers[-1] is not None:
                own = _number(node, "value")
                at, step = numbers[-1] if own is None else (own, numbers[-1][1])
                mark, numbers[-1] = f"{at}. ", [at + step, step]
            out.lead.append(mark)
        elif tag in ("blockquote", "dd"):
            out.lead.append("  " if len(out.lead) < DEEPEST else "")
        stack.append((node, iter(node.children), tag in ("pre", "textarea", "listing", "xmp", "plaintext")))

    def leave(node: Node) -> None:
        tag = node.tag
        if tag in SPACED and not (tag in ("ul", "ol") and len(numbers) > 1):
            out.margin()
        elif tag in BLOCK:
            out.break_line()
        if tag in ("ul", "ol", "menu", "dir"):
            numbers.pop()
            out.lead.pop()
        elif tag in ("li", "blockquote", "dd"):
            out.lead.pop()

    exact = 0
    enter(top)
    exact += stack[-1][2]
    while stack:
        node, children, pre = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            exact -= pre
            leave(node)
        elif isinstance(child, str):
            if exact:
                out.exact(child)
            else:
                out.text(child)
        elif hidden(child):
            continue
        elif child.tag == "table":
            out.margin()
            _table(child, out, most)
            out.margin()
        else:
            enter(child)
            exact += stack[-1][2]


def to_text(html: str | None) -> str | None:
    if html is None:
        return None
    out, root = Layout(), parse(html)
    low = html.lower()
    if "<style" in low:
        _apply_styles(root)
    if "visibility" in low:
        _blank_invisible(root)
    limit, wanted = sys.getrecursionlimit(), 3 * low.count("<table") + 1000  # calls of Python functions take no stack of C
    sys.setrecursionlimit(max(limit, wanted))
    try:
        _render(root, out, max(LEAST_PADDED, PADDED * len(html)))
    finally:
        sys.setrecursionlimit(limit)
    out.break_line()
    return "\n".join(out.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars for each row; other columns are ignored; null html: null text."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [to_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(text, pa.string()), pa.array([None if t is None else len(t) for t in text], pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, text string, n_chars long")
