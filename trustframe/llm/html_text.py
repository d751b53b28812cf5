"""Layout-aware text of HTML pages.

A tokenizer cuts the source into tags, text and raw parts; the tree builder
keeps the open elements, adds the tags the source implies (a block ends an open
paragraph, an item the item before it, a cell the cell before it, page content
an open head, ...) and ignores stray end tags; the renderer turns the balanced events into text:

* invisible elements (``INVISIBLE``, ``hidden``, ``display:none``,
  ``visibility:hidden``, closed ``dialog`` and ``details``) emit nothing;
* white space collapses outside ``pre`` and ``textarea``; ``br`` ends a line;
* blocks start on a new line, paragraphs, headings, lists, tables and quotes
  stand between blank lines;
* list items get ``*`` or their number and are indented under their list;
* table cells are padded to the width of their column, ``colspan`` covers
  several; a cell of several lines makes a row of several lines; a cell with
  ``rowspan`` keeps its columns free in the rows below, up to its row group's end;
* text of svg and math is shown, except what browsers never draw
  (``UNDRAWN``); labels of a drawing and cells of a formula are kept apart.

Nothing recurses, so nesting may be of any depth.  Null and empty pages give
an empty text.  Unclosed comments, tags and raw elements end with the page.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

# ---- fixed values: element classes of HTML --------------------------------
INVISIBLE = frozenset("head script style template title meta link base noframes iframe object "
                      "audio video canvas datalist area param source track".split())
RAW = frozenset("script style title textarea xmp iframe noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address "
                           "li dt dd form details summary dialog legend figcaption caption "
                           "center option optgroup search hgroup menu tr".split())
# start tags that leave an open head open
HEAD = frozenset("html head title meta link base basefont bgsound style script noscript noframes "
                 "template".split())
# svg and math: elements that are not drawn, that hold HTML, that stand apart
UNDRAWN = frozenset("title desc metadata style script defs symbol clippath mask marker pattern "
                    "filter lineargradient radialgradient annotation annotation-xml".split())
HOLDS_HTML = {"svg": frozenset(("foreignobject", "desc", "title")),
              "math": frozenset(("mi", "mo", "mn", "ms", "mtext"))}
APART = frozenset((("svg", "text"), ("math", "mtd")))
# HTML start tags that end open svg and math elements
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 "
                     "head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
                     "strike sub sup table tt u ul var".split())
# an opening tag ends these open elements, up to the nearest of the second set
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("tr",))
_PARTS = frozenset(("thead", "tbody", "tfoot"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_CELLS | _ROWS, frozenset(("table",))),
    **{t: (_CELLS | _ROWS | _PARTS | {"caption", "colgroup"}, frozenset(("table",)))
       for t in _PARTS},
}
# ---------------------------------------------------------------------------

# a quote opens a value only directly after "="; any other is an ordinary character
_S = r"[ \t\n\r\f]"
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*"
_BARE = r"[^ \t\n\r\f>\"'][^ \t\n\r\f>]*"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*)"
                    rf"((?:{_S}|/|{_NAME}(?:{_S}*={_S}*"
                    rf"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|{_BARE})?)?)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_S}*={_S}*(?:\"([^\"]*)\"?|'([^']*)'?|({_BARE}))?)?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b")
_INTEGER = re.compile(r"\s*([+-]?)0*(\d{1,12})", re.ASCII)
# limits of HTML itself for spans; counts of lists are 32-bit numbers
MOST_COLUMNS, MOST_ROWS, MOST_COUNT = 1000, 65534, 2**31 - 1
GAP = 2


_UNWALLED = _CELLS | _ROWS | _PARTS | {"table", "body", "html"}


class _Open:
    """The open elements; counts answer whether a tag is open without a search."""

    def __init__(self):
        self.stack: list[str] = []
        self.kinds: list[tuple[str, str]] = []   # svg, math or "": each element's, its children's
        self.count: dict[str, int] = {}

    def inside(self) -> str:
        """svg or math where a start tag would be one of its elements, else ""."""
        return self.kinds[-1][1] if self.kinds else ""

    def push(self, tag: str, kind: str = "", holds: str = ""):
        self.stack.append(tag)
        self.kinds.append((kind, holds))
        self.count[tag] = self.count.get(tag, 0) + 1
        return tag

    def cut(self, depth: int):
        while len(self.stack) > depth:
            tag = self.stack.pop()
            kind, _ = self.kinds.pop()
            self.count[tag] -= 1
            yield "end", tag, None
            if (kind, tag) in APART:
                yield "text", " ", None

    def any(self, tags) -> bool:
        return any(self.count.get(t) for t in tags)

    def nearest(self, tags, scope) -> int | None:
        """Depth of the outermost of ``tags`` above the nearest of ``scope``."""
        found, depth = None, len(self.stack)
        while self.any(tags) and depth and self.stack[depth - 1] not in scope:
            depth -= 1
            if self.stack[depth] in tags:
                found = depth
        return found


def events(source: str):
    """(kind, tag or text, attributes) with every start tag ended, in order."""
    is_open = _Open()
    at = 0
    while at <= len(source):
        m = _TOKEN.search(source, at)
        text = source[at:m.start() if m else len(source)]
        if text:
            text = html.unescape(text)
            if text.strip(" \t\n\r\f"):
                yield from _past_head(is_open)
            yield "text", text, None
        if m is None:
            break
        at = m.end() if m.end() > at else at + 1
        if is_open.inside() and source.startswith("<![CDATA[", m.start()):
            stop = source.find("]]>", m.start() + 9)
            yield "text", source[m.start() + 9:stop if stop >= 0 else len(source)], None
            at = stop + 3 if stop >= 0 else len(source) + 1
            continue
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br" or not m.group(1) and tag not in HEAD:
            yield from _past_head(is_open)
        if m.group(1):
            yield from _ended(tag, is_open)
            continue
        if is_open.inside() and tag in BREAKOUT:
            yield from is_open.cut(next(d for d in range(len(is_open.stack), -1, -1)
                                        if not d or not is_open.kinds[d - 1][1]))
        kind = tag if tag in HOLDS_HTML else is_open.inside()
        if not kind:
            yield from _implied(tag, is_open)
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in
                      _ATTRIBUTE.findall(m.group(3))} if m.group(3).strip(" \t\r\n/") else {}
        if kind and (tag in UNDRAWN or attributes.get("display") == "none"
                     or attributes.get("visibility") in ("hidden", "collapse")):
            attributes["hidden"] = ""
        if (kind, tag) in APART:
            yield "text", " ", None
        yield "start", tag, attributes
        if kind:
            if _self_closed(m.group(3)):
                yield "end", tag, None
            else:
                html_inside = tag in HOLDS_HTML[kind] or tag == "annotation-xml" and (
                    attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"))
                is_open.push(tag, kind, "" if html_inside else kind)
        elif tag in VOID:
            yield "end", tag, None
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            raw = source[at:stop.start() if stop else len(source)]
            if raw:
                yield "raw", html.unescape(raw) if tag in ("textarea", "title") else raw, None
            yield "end", tag, None
            at = stop.end() if stop else len(source) + 1
        else:
            is_open.push(tag)
    yield from is_open.cut(0)


def _self_closed(inner: str) -> bool:
    """Whether the inner part of a tag ends with a slash that no attribute value holds."""
    if not inner.endswith("/"):
        return False
    end = 0
    for m in _ATTRIBUTE.finditer(inner):
        end = m.end()
    return end < len(inner)


def _past_head(is_open: _Open):
    """Ends an open head; what stands in a template belongs to the template."""
    if is_open.count.get("head") and not is_open.count.get("template"):
        yield from is_open.cut(is_open.stack.index("head"))


def _ended(tag: str, is_open: _Open):
    """An end tag: closes its element unless a cell or table stands between."""
    if not is_open.count.get(tag):
        if tag in ("p", "br"):
            yield "start", tag, {}
            yield "end", tag, None
        return
    wall = frozenset() if tag in _UNWALLED else _CELLS | {"table"}
    depth = len(is_open.stack) - 1
    while is_open.stack[depth] != tag:
        if is_open.stack[depth] in wall:
            return
        depth -= 1
    yield from is_open.cut(depth)


def _implied(tag: str, is_open: _Open):
    """End tags and start tags that ``tag`` implies."""
    if tag in BLOCK and tag not in ("html", "body", "option", "optgroup") or tag in _PARTS:
        p = is_open.nearest(("p",), _CELLS | {"table", "li", "dd", "div", "body"})
        if p is not None:
            yield from is_open.cut(p)
    if tag in IMPLIED:
        ends, scope = IMPLIED[tag]
        depth = is_open.nearest(ends, scope)
        if depth is not None:
            yield from is_open.cut(depth)
    if tag in _CELLS and is_open.count.get("table") and is_open.stack[-1] != "tr":
        yield "start", is_open.push("tr"), {}


class Page:
    """Lines of one flow: the page, or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.blank, self.marker = "", False, False, ""
        self.indent: list[int] = []

    def words(self, text: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end_line(True)
                self.line += part.rstrip("\r")
            return
        parts = _SPACE.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = bool(self.line)
            if part:
                self.line += (" " if self.space else "") + part
                self.space = False

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            pad = " " * max(0, sum(self.indent) - len(self.marker))
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((pad + self.marker + self.line).rstrip())
            self.line, self.marker = "", ""
        self.space = False

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _width(s: str) -> int:
    """Columns of a text; wide East Asian characters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1
               for c in s)


def _placed(rows: list) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, colspan) of each row's cells beside the cells that reach down to it.

    ``None`` between rows ends a row group, which no cell leaves.
    """
    out, until = [], []              # row number at which each column is free again
    for row in rows:
        if row is None:
            until = []
            continue
        r, c, cells = len(out), 0, []
        for lines, span, down in row:
            while c < len(until) and until[c] > r:
                c += 1
            cells.append((c, lines, span))
            if down != 1:
                until += [0] * (c + span - len(until))
                for k in range(c, c + span):
                    until[k] = max(until[k], r + down if down else math.inf)
            c += span
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Rows of (lines, colspan, rowspan) cells as lines with aligned columns."""
    placed = _placed(rows)
    width: list[int] = []
    for row in placed:
        for c, lines, span in row:
            width += [0] * (c + span - len(width))
            if span == 1:
                width[c] = max([width[c], *map(_width, lines)])
    for row in placed:
        for c, lines, span in row:
            need = max([0, *map(_width, lines)]) - sum(width[c:c + span]) - GAP * (span - 1)
            if need > 0:
                width[c + span - 1] += need
    starts = [0, *accumulate(w + GAP for w in width)]
    out = []
    for row in placed:
        for k in range(max([0, *(len(lines) for _, lines, _ in row)])):
            text = ""
            for c, lines, _ in row:
                text += " " * (starts[c] - _width(text)) + (lines[k] if k < len(lines) else "")
            out.append(text.rstrip())
    return out


def _number(text: str, otherwise: int, most: int) -> int:
    """The integer of an attribute, at most ``most`` either way; digits beyond that are not read."""
    m = _INTEGER.match(text)
    if m is None:
        return otherwise
    n = int(m[2]) if len(m[2]) <= len(str(most)) else most
    return -min(n, most) if m[1] == "-" else min(n, most)


def _hidden(tag: str, a: dict) -> bool:
    return (tag in INVISIBLE or "hidden" in a or tag == "dialog" and "open" not in a
            or tag == "input" or "style" in a and bool(_GONE.search(a["style"].lower())))


def render(source: str) -> str:
    """Visible text of one page."""
    flows, tables, lists = [Page()], [], []
    hidden = kept = 0                # depth inside invisible and preformatted elements
    closed: list[int] = []           # open elements inside each closed details
    opened: list[tuple] = []         # what each open element must undo
    for kind, what, a in events(source):
        page = flows[-1]
        if kind in ("text", "raw"):
            if not hidden and not (closed and closed[-1] == len(opened)):
                page.words(what, bool(kept))
            continue
        if kind == "start":
            hide = hidden or _hidden(what, a)
            undo = (what, bool(hide), len(tables))
            if closed and closed[-1] == len(opened) and what != "summary":
                hide = True
                undo = (what, True, len(tables))
            opened.append(undo)
            if what == "details" and "open" not in a:
                closed.append(len(opened))
            if hide:
                hidden += 1
                continue
            if what == "br":
                page.end_line(True)
            elif what == "table":
                page.gap()
                tables.append([])
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in _PARTS and tables:
                tables[-1].append(None)
            elif what in _CELLS and tables:
                if not tables[-1] or tables[-1][-1] is None:
                    tables[-1].append([])
                span, down = a.get("colspan", "1"), a.get("rowspan", "1")
                tables[-1][-1].append([None, max(_number(span, 1, MOST_COLUMNS), 1),
                                       _number(down, 1, MOST_ROWS) if down.isdecimal() else 1])
                flows.append(Page())
            elif what in BLOCK:
                (page.gap if what in SPACED and not (what in ("ul", "ol") and lists)
                 else page.end_line)()
                if what in ("ul", "ol", "menu"):
                    start = a.get("start", "1")
                    lists.append(_number(start, 1, MOST_COUNT) if what == "ol" else None)
                    page.indent.append(0)
                elif what == "li":
                    n = lists[-1] if lists else None
                    if n is not None:
                        n = _number(a.get("value", ""), n, MOST_COUNT)
                    page.marker = "* " if n is None else f"{n}. "
                    if lists and n is not None:
                        lists[-1] = n + 1
                    page.indent.append(len(page.marker))
                elif what in ("dd", "blockquote"):
                    page.indent.append(4)
            if what in ("pre", "textarea"):
                kept += 1
            continue
        tag, was_hidden, depth = opened.pop()
        if closed and len(opened) < closed[-1]:
            closed.pop()
        if was_hidden:
            hidden -= 1
            continue
        if tag in ("pre", "textarea"):
            kept -= 1
        if tag == "table" and tables:
            rows = [row and [(lines or [], span, down) for lines, span, down in row]
                    for row in tables.pop()]
            page.gap()
            for line in table_lines(rows):
                page.line = line
                page.end_line(True)
            page.gap()
        elif tag in _CELLS and depth and len(flows) > 1:
            flows.pop()
            tables[-1][-1][-1][0] = page.done()
        elif tag in _PARTS and tables:
            tables[-1].append(None)
        elif tag in BLOCK and tag != "tr":
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            (page.gap if tag in SPACED and not (tag in ("ul", "ol") and lists)
             else page.end_line)()
            if tag in ("ul", "ol", "menu", "li", "dd", "blockquote") and page.indent:
                page.indent.pop()
    return "\n".join(flows[0].done()).strip("\n").replace("\xa0", " ")


def extract(pages: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """``keep`` plus ``text``, the visible text of each page."""
    def rows(sources):
        return [[render(s.decode("utf-8", "replace")) for s in sources]]

    return append_columns(pages, keep, source, [T.StructField("text", T.StringType())], rows)
