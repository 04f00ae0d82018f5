"""Layout-aware text of HTML pages.

A tree builder reads the tags in order, closes elements whose end tags may be left out, ignores stray end tags and
knows which elements are hidden. Its open and close events drive a renderer that keeps what layout says: paragraphs and
headings stand apart, line breaks and preformatted text stay, list items have markers and indentation, table cells are
aligned in columns. Everything visible is emitted, once and in order; nesting of any depth needs no recursion.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import small_batches


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element classes of the HTML standard. Fixed values.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes plaintext")
ESCAPABLE = _set("textarea title")
HIDDEN = _set("head title script style template noscript iframe noembed noframes object video audio canvas datalist rp "
              "area base link meta param source track")
APART = _set("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure table hr fieldset")
BLOCK = APART | _set("html body div section article aside header footer nav main address form details summary li dt dd "
                     "figcaption legend center dir hgroup search optgroup option listing xmp dialog caption tr thead tbody "
                     "tfoot td th")
ENDS_P = APART | _set("div section article aside header footer nav main address form details summary li dt dd figcaption "
                      "center dir hgroup search listing xmp dialog")
_SCOPE = _set("table td th caption html template object applet marquee button")
#: An element of the key closes an open one of the values, unless one of the stops stands between.
IMPLIED = {
    "li": (_set("li"), _SCOPE | _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _SCOPE | _set("dl")), "dd": (_set("dt dd"), _SCOPE | _set("dl")),
    "option": (_set("option"), _set("select datalist optgroup")), "optgroup": (_set("option optgroup"), _set("select")),
    "tr": (_set("tr td th caption colgroup"), _set("table")), "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "tbody": (_set("tbody thead tfoot tr caption colgroup"), _set("table")),
    "thead": (_set("tbody thead tfoot tr caption colgroup"), _set("table")),
    "tfoot": (_set("tbody thead tfoot tr caption colgroup"), _set("table")),
    "caption": (_set("caption colgroup"), _set("table")), "colgroup": (_set("caption colgroup"), _set("table")),
    "body": (_set("head"), _set("html")), "rt": (_set("rt rp"), _set("ruby")), "rp": (_set("rt rp"), _set("ruby")),
}
_HEADINGS = _set("h1 h2 h3 h4 h5 h6")
_IN_HEAD = _set("title script style meta link base template noscript head html")
_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"-?[0-9]{1,9}")
#: Columns are as wide as their longest cell up to here, or as their longest word; longer lines go on below.
WIDEST = 60


def number(text: str, missing: int) -> int:
    """An attribute's value, if it is a plain number of at most nine digits."""
    return int(text) if _NUMBER.fullmatch(text) else missing


class Flow:
    """Lines of a block of text: collapsed white space, pending gaps, markers and indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[list] = []

    def text(self, s: str, keep_space: bool) -> None:
        if keep_space:
            first, *more = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for part in more:
                self.break_line()
                self._put(part)
            return
        s = _BLANKS.sub(" ", s)
        if s[:1] == " ":
            self.space = True
            s = s[1:]
        if not s:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = s[-1] == " "
        self._put(s.rstrip(" "))

    def _put(self, s: str) -> None:
        if s:
            self.line.append(s)

    def break_line(self) -> None:
        """End the line even if it is empty."""
        self._emit("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        """End the line if it has text; the next text stands at least ``gap`` empty lines below."""
        if self.line:
            self.break_line()
        self.space = False
        self.gap = max(self.gap, gap)

    def _emit(self, s: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        prefix = ""
        for indent in self.indents:
            if indent[0] is not None:
                prefix += indent[0]
                indent[0] = None
            else:
                prefix += " " * indent[1]
        self.lines.append((prefix + s).rstrip(" ") if s or prefix.strip() else "")

    def whole(self) -> list[str]:
        self.block(0)
        return self.lines


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[str] = []


def wrapped(line: str, width: int) -> list[str]:
    """The line cut at blanks into lines of at most ``width``."""
    out, at = [], 0
    while len(line) - at > width and (cut := line.rfind(" ", at + 1, at + width + 1)) > 0:
        out.append(line[at:cut])
        at = cut + 1
    return [*out, line[at:]]


def placed_cells(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns covered, lines) of the cells of each row; cells of rows above keep their columns as far as they span."""
    taken: dict[int, int] = {}  # column: rows it is still covered for
    out = []
    for row in rows:
        at, cells = 0, []
        covered = {c for c, left in taken.items() if left > 0}
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        for lines, span, down in row:
            while at in covered:
                at += 1
            cells.append((at, span, lines))
            for column in range(at, at + span) if down > 1 else ():
                taken[column] = max(taken.get(column, 0), down - 1)
            at += span
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns covered, rows covered) as aligned lines, two spaces between columns."""
    widths: list[int] = []
    placed = placed_cells(rows)

    def needed(lines: list[str]) -> int:
        longest = max(map(len, lines), default=0)
        return longest if longest <= WIDEST else max(WIDEST, *(len(w) for line in lines for w in line.split(" ")))
    cells = [cell for row in placed for cell in row]
    widths.extend([0] * max((at + span for at, span, _ in cells), default=0))
    for at, span, lines in sorted(cells, key=lambda c: c[1]):  # what a wide cell needs beyond its columns goes to the last one
        room = sum(widths[at:at + span]) + 2 * (span - 1)
        widths[at + span - 1] += max(0, needed(lines) - room)
    edges = [0, *itertools.accumulate(w + 2 for w in widths)]
    out = []
    for row in placed:
        shown = [(at, [part for line in lines for part in wrapped(line, edges[at + span] - edges[at] - 2)])
                 for at, span, lines in row]
        for n in range(max((len(lines) for _, lines in shown), default=0)):
            line = ""
            for at, lines in shown:
                line = line.ljust(edges[at]) + (lines[n] if n < len(lines) else "")
            out.append(line.rstrip())
    return out


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.flows = [Flow()]
        self.tables: list[_Table] = []
        # Open elements: tag, hidden with its children, visibility, keeps white space, counter of a list.
        self.open: list[list] = []
        self.counts: dict[str, int] = {}

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def _top(self) -> list:
        return self.open[-1] if self.open else ["", False, True, False, None]

    def text(self, s: str) -> None:
        _, hidden, visible, keep_space, _ = self._top()
        if s.strip(" \t\n\r\f") and self.counts.get("head") and self._top()[0] == "head":
            self.close("head")
            hidden = self._top()[1]
        if not hidden and visible and self._top()[4] != "closed":
            if self._top()[0] in ("table", "tr", "tbody", "thead", "tfoot") and not s.strip(" \t\n\r\f"):
                return
            self.flow.text(html.unescape(s) if "&" in s else s, keep_space)

    def start(self, tag: str, raw: str) -> None:
        if self.counts.get("head") and tag not in _IN_HEAD and self._top()[0] == "head":
            self.close("head")
        if tag in ENDS_P and self.counts.get("p"):
            self._imply(_set("p"), _SCOPE)
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        elif tag in _HEADINGS and self._top()[0] in _HEADINGS:
            self._pop()
        if tag in ("td", "th") and self.counts.get("table") and not self._inside("tr"):
            self.start("tr", "")
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}
        _, hidden, visible, keep_space, _ = self._top()
        closed_details = self.open and self.open[-1][0] == "details" and self.open[-1][4] == "closed"
        if tag in HIDDEN or "hidden" in attributes or (tag == "dialog" and "open" not in attributes) or (
                closed_details and tag != "summary"):
            hidden = True
        if tag == "input" and attributes.get("type", "").lower() == "hidden":
            hidden = True
        for name, value in _STYLE.findall(attributes.get("style", "")):
            if name.lower() == "display":
                hidden = hidden or value.lower() == "none"
            else:
                visible = value.lower() not in ("hidden", "collapse")
        if not hidden:
            self._begin(tag, attributes, visible)
        if tag in VOID:
            return
        if tag in ("pre", "textarea", "listing", "xmp", "plaintext"):
            keep_space = True
        state = None
        if tag in ("ul", "ol", "menu", "dir"):
            state = [tag == "ol", number(attributes.get("start", ""), 1)]
        elif tag == "details":
            state = None if "open" in attributes else "closed"
        self.open.append([tag, hidden, visible, keep_space, state])
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _begin(self, tag: str, attributes: dict[str, str], visible: bool) -> None:
        flow = self.flow
        if tag == "br":
            flow.break_line()
        elif tag == "wbr":
            pass
        elif tag == "hr":
            flow.block(1)
        elif tag == "table":
            flow.block(1)
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and self.tables:
            self.flows.append(Flow())
            span, down = (number(attributes.get(name, ""), 1) for name in ("colspan", "rowspan"))
            self.flow.span = min(span, 1000) if span > 0 else 1  # the largest values that HTML knows
            self.flow.down = 65534 if down == 0 else min(max(down, 1), 65534)
        elif tag == "li":
            flow.block(0)
            parent = next((e[4] for e in reversed(self.open) if e[0] in ("ul", "ol", "menu", "dir")), None)
            marker = "- "
            if parent and parent[0]:
                parent[1] = number(attributes.get("value", ""), parent[1])
                marker = f"{parent[1]}. "
                parent[1] += 1
            flow.indents.append([marker if visible else None, len(marker)])
        elif tag in ("dd", "blockquote"):
            flow.block(1 if tag == "blockquote" else 0)
            flow.indents.append([None, 4])
        elif tag in ("ul", "ol", "menu", "dir", "dl"):
            flow.block(0 if any(self.counts.get(x) for x in ("ul", "ol", "menu", "dir", "dl")) else 1)
        elif tag in APART:
            flow.block(1)
        elif tag in BLOCK:
            flow.block(0)

    def _end(self, element: list) -> None:
        tag, flow = element[0], self.flow
        if tag in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
            cell = self.flows.pop()
            table = self.tables[-1]
            if tag == "caption":
                table.captions += cell.whole()
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((cell.whole(), cell.span, cell.down))
        elif tag == "table" and self.tables:
            table = self.tables.pop()
            flow.block(1)
            for line in [*table.captions, *table_lines(table.rows)]:
                flow.line = [line] if line else []
                flow.break_line()
            flow.block(1)
        elif tag in ("li", "dd", "blockquote"):
            flow.block(1 if tag == "blockquote" else 0)
            if flow.indents:
                marker = flow.indents.pop()[0]
                if marker and tag == "li":
                    flow.indents.append([marker, len(marker)])
                    flow._emit("")
                    flow.indents.pop()
        elif tag in ("ul", "ol", "menu", "dir", "dl"):
            flow.block(0 if any(self.counts.get(x) for x in ("ul", "ol", "menu", "dir", "dl")) else 1)
        elif tag in APART:
            flow.block(1)
        elif tag in BLOCK:
            flow.block(0)

    def _pop(self) -> None:
        element = self.open.pop()
        self.counts[element[0]] -= 1
        if not element[1]:
            self._end(element)

    def _inside(self, tag: str) -> bool:
        for element in reversed(self.open):
            if element[0] == tag:
                return True
            if element[0] == "table":
                return False
        return False

    def _imply(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        """Close open elements of the tags, with what stands in them, as far as the next stop."""
        if not any(self.counts.get(t) for t in tags):
            return
        last = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                last = i
            elif self.open[i][0] in stops:
                break
        while last is not None and len(self.open) > last:
            self._pop()

    def close(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if not self.counts.get(tag):
            if tag == "p" and not self._top()[1]:
                self.flow.block(1)
            return
        stops = frozenset() if tag in ("table", "html", "body") else _set("table") if tag in (
            "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else _set("td th caption") - {tag}
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in stops:
                return

    def read(self, source: str) -> str:
        at, size = 0, len(source)
        while at < size:
            low = source.find("<", at)
            if low < 0:
                self.text(source[at:])
                break
            m = _TOKEN.match(source, low)
            if m is None:
                self.text(source[at:low + 1])
                at = low + 1
                continue
            if low > at:
                self.text(source[at:low])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.start(tag, m[3].rstrip("/ ") if m[3] else "")
            if tag in ("pre", "textarea", "listing"):  # a line break right behind the tag is not part of the text
                at += 2 if source[at:at + 2] == "\r\n" else source[at:at + 1] in ("\n", "\r")
            if tag in RAW or tag in ESCAPABLE:
                end = None if tag == "plaintext" else re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                inner = source[at:end.start() if end else size]
                if tag in ESCAPABLE:
                    self.text(inner)
                elif not self._top()[1]:
                    self.flow.text(inner, True)
                self.close(tag)
                at = source.find(">", end.start()) + 1 or size if end else size
        while self.open:
            self._pop()
        lines = self.flows[0].whole()
        return "\n".join(lines).strip("\n")


def render(source: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty text, text without tags is one paragraph."""
    return Page().read(source) if source else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for every row, from whole pages.

    Null and empty pages and those without visible text have an empty text. Repeated rows each get their row, null ids
    stay null, other columns are ignored. Broken markup never fails: what is no tag is text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [render(v.as_py()) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return small_batches(rows).mapInArrow(run, "page_id long, text string")
