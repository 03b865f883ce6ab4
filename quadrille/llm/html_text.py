"""HTML to text as a reader would see it.

A tree builder keeps the open elements, with the tags that HTML implies: start tags
that end others, end tags that are missing or have no start. As elements open and
close, a renderer lays out the text that is visible: blocks on lines of their own,
paragraphs and the like parted by an empty line, list items with marks and
indented, table cells in columns, preformatted text as it is. No node is kept
longer than it is open, and nothing recurses, so depth and length don't matter.
Work and text grow in proportion to the page: lines are indented by INDENT spaces at
most, a table has COLUMNS columns (further cells follow two spaces apart), and the
cells of all tables are padded by four times the page's length at most; tables that
would take more have their cells two spaces apart.

Malformed input gives some text and no error, as in a browser.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quadrille.llm.common import beside, row_columns, table, text_or_empty

# Fixed values of HTML: elements without content, elements that are never shown, blocks, and
# blocks with an empty line around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title datalist iframe svg annotation annotation-xml audio video canvas select textarea noembed noframes".split())
#: Fixed values of HTML and SVG: what is looked through for text in a drawing, and what shows text there.
DRAWN, DRAWN_TEXT = frozenset("svg g a switch".split()), frozenset("text foreignobject".split())
#: What does not end a head that is not closed.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav section summary tr td th caption thead tbody tfoot search".split())
#: Fixed values of HTML: for a start tag, the open elements that it ends, and those it does not look beyond.
_CELL, _PART = ("td", "th"), ("thead", "tbody", "tfoot")
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "caption"), ("table",)),
    **dict.fromkeys(_PART, ((*_PART, "tr", "caption"), ("table",))),
    "body": (("head",), ()),
}
#: Elements that an end tag of another element does not reach through.
SCOPES = frozenset(("td", "th", "table", "caption", "html", "template"))
SPACE = re.compile(r"[ \t\n\f\r]+")
#: A comment, a start or end tag with what follows its name, or another declaration. Repeats are
#: possessive, so that a match or a failure takes one pass.
TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
#: The attributes that matter to what is seen.
READ = re.compile("style|hidden|open|alt|start|span", re.I)
#: Elements whose content has no tags, and their ends.
#: Spaces that a line is indented at most, and columns of a table that are kept apart.
INDENT, COLUMNS = 32, 500
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


def attributes(text: str, choice: bool = False) -> dict[str, str]:
    """The attributes in a start tag, the first of each name; none if none of them matters, as all may in a choice."""
    if not choice and not READ.search(text):
        return {}
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return out


@dataclass
class Page:
    """Lines of text, with the space that is due before the next one."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    gap: int = 0
    space: bool = False
    indent: str = ""
    #: What the next line begins with in place of the indent: a list item's mark.
    first: str | None = None

    def flow(self, text: str) -> None:
        """Text in which white space is one space, none at the ends of a line."""
        text = SPACE.sub(" ", text)
        self.space |= text[:1] == " "
        if words := text.strip(" "):
            self._begin()
            if self.space and len(self.line) > 1:
                self.line.append(" ")
            self.line.append(words)
            self.space = text[-1] == " "

    def exact(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self._begin()
                self._end()
            if part:
                self._begin()
                self.line.append(part)

    def _begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap, self.space = 0, False
            self.line.append(self.indent if self.first is None else self.first)
            self.first = None

    def _end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []

    def break_line(self) -> None:
        if self.line:
            self._end()
        elif self.lines:
            self.gap = max(self.gap, 1) + 1 if self.gap < 2 else self.gap
        self.space = False

    def block(self, gap: int) -> None:
        """The next text is on a new line, after gap - 1 empty ones at least."""
        self._end()
        self.gap, self.space = max(self.gap, gap), False

    def rows(self, lines: list[str]) -> None:
        for text in lines:
            self._begin()
            self.line.append(text)
            self._end()

    def text(self) -> str:
        self._end()
        return "\n".join(self.lines)


@dataclass
class Grid:
    """A table in the making: rows of cells (column, columns it spans, lines), and where cells reach down."""

    rows: list[list[tuple[int, int, list[str]]]] = field(default_factory=list)
    #: By column: how many columns the cell has that reaches down there, and its last row.
    reached: dict[int, tuple[int, int]] = field(default_factory=dict)
    at: int = 0
    caption: list[str] = field(default_factory=list)

    def begin_row(self) -> None:
        self.rows.append([])
        self.at = 0

    def add(self, lines: list[str], columns: int, rows: int) -> None:
        """A cell in the next column that no cell from above reaches."""
        if not self.rows:
            self.begin_row()
        here = len(self.rows) - 1
        while (above := self.reached.get(self.at)) and above[1] >= here:
            self.at += above[0]
        at = min(self.at, COLUMNS)
        columns = max(1, min(columns, COLUMNS - at))
        self.rows[-1].append((at, columns, lines))
        if rows > 1 and at < COLUMNS:
            self.reached[at] = (columns, here + rows - 1)
        self.at = at + columns

    def lines(self, room: int) -> tuple[list[str], int]:
        """The table's lines, and how much they are padded: columns as wide as their widest cell, two spaces
        apart, or, where that takes more than room spaces, cells two spaces apart. A cell over several
        columns widens the last."""
        rows = [r for r in self.rows if any(lines for *_, lines in r)]
        widths = [0] * (max((at + n for r in rows for at, n, _ in r), default=0) + 1)
        for spanning in (False, True):
            for r in rows:
                for at, n, lines in r:
                    if (n > 1) == spanning:
                        widths[at + n - 1] += max(0, max(map(len, lines), default=0) - sum(widths[at : at + n]) - 2 * (n - 1))
        starts = [0, *accumulate(w + 2 for w in widths)]
        out: list[list[tuple[int, str]]] = []
        for r in rows:
            of_row: list[list[tuple[int, str]]] = [[] for _ in range(max(len(lines) for *_, lines in r))]
            for at, _, lines in r:
                for k, text in enumerate(lines):
                    if text:
                        of_row[k].append((starts[at], text))
            out += of_row
        padding = sum(line[-1][0] - sum(len(text) for _, text in line[:-1]) for line in out if line)
        if padding > room:
            return self.caption + ["  ".join(text for _, text in line).rstrip(" ") for line in out], 0
        made = list(self.caption)
        for line in out:
            parts, length = [], 0
            for start, text in line:
                gap = max(start - length, 2 if length else 0)
                parts += [" " * gap, text]
                length += gap + len(text)
            made.append("".join(parts).rstrip(" "))
        return made, padding


@dataclass
class Element:
    tag: str
    seen: bool
    shown: bool
    exact: bool
    number: int | None = None
    columns: int = 1
    rows: int = 1
    holder: Page | None = None
    grid: Grid | None = None
    indent: str | None = None
    #: A drawing, or a part of one, whose texts are seen.
    drawn: bool = False
    #: Of a select that shows one option: the text, whether it is selected and whether it is disabled of each.
    options: list[list] | None = None


def _whole(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.strip().isdigit() and len(value) < 10 else 1


class Renderer:
    def __init__(self, room: int = 1 << 20):
        """room: so many spaces may be spent to align the cells of tables."""
        self.page, self.room = Page(), room
        self.open: list[Element] = [Element("#root", True, True, False)]
        #: The places in open of the elements of each tag.
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    # Tags

    def feed(self, html: str) -> None:
        """Go through a page once. What does not end, ends with the page, as in a browser."""
        at = 0
        while (start := html.find("<", at)) >= 0:
            if not (m := TAG.match(html, start)):
                self._data(html[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self._data(html[at:start])
            at = m.end()
            if m["name"]:
                tag = m["name"].lower()
                if m["end"]:
                    self.end_tag(tag)
                    continue
                self.start_tag(tag, attributes(m["more"], tag in ("select", "option")))
                if tag in RAW:
                    close = RAW[tag].search(html, at)
                    if tag in ("textarea", "title", "xmp"):
                        self._data(html[at : close.start() if close else len(html)])
                    at = close.start() if close else len(html)
        if at < len(html):
            self._data(html[at:])

    def _data(self, text: str) -> None:
        self.text(unescape(text) if "&" in text else text)

    # The tree builder

    def start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCKS:
            self._end_first(("p",), SCOPES)
        if tag in IMPLIED_END:
            ended, scope = IMPLIED_END[tag]
            while self._end_first(ended, scope):
                pass
        if tag in _CELL and self._in_table() and self._nearest(("tr", "table")) != "tr":
            self._start("tr", {})
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close()
        self._start(tag, attrs)
        if tag in VOID:
            self._close()

    def end_tag(self, tag: str) -> None:
        scope = () if tag in SCOPES else SCOPES - {tag}
        if tag == "br":
            self.start_tag("br", {})
        elif tag not in VOID:
            self._end_first((tag,), scope)

    def _innermost(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _end_first(self, tags, scope) -> bool:
        """Close the innermost open element of these tags and all in it, unless one of scope comes first."""
        at = self._innermost(tags)
        if not at or self._innermost(scope) > at:
            return False
        while len(self.open) > at:
            self._close()
        return True

    def _nearest(self, tags) -> str | None:
        at = self._innermost(tags)
        return self.open[at].tag if at else None

    def _in_table(self) -> bool:
        return self._nearest(("table",)) is not None

    # Visibility and layout

    def _start(self, tag: str, attrs: dict) -> None:
        above = self.open[-1]
        style = re.sub(r"\s", "", attrs.get("style") or "").lower()
        away = "hidden" in attrs or "display:none" in style
        many = tag == "select" and ("multiple" in attrs or _whole(attrs.get("size"), 1000) > 1)
        shown = (above.shown and (tag not in UNSEEN or many) or above.drawn and tag in DRAWN_TEXT) and not away and not (tag == "dialog" and "open" not in attrs)
        if above.tag == "details" and above.number == 0 and tag != "summary":
            shown = False
        seen = not ("visibility:hidden" in style or "visibility:collapse" in style) and (above.seen or "visibility:visible" in style)
        here = Element(tag, seen, shown, (above.exact or tag in ("pre", "listing", "xmp") or "white-space:pre" in style) and "white-space:normal" not in style)
        if tag == "details":
            here.number = 0 if "open" not in attrs else None
        here.drawn = not away and (above.shown and tag == "svg" or above.drawn and tag in DRAWN)
        if tag == "select" and above.shown and not away and not many and seen:
            here.options = []
        elif tag == "option" and (choice := self._choice()) is not None:
            choice.append([attrs.get("label") or "", "selected" in attrs, "disabled" in attrs, bool(attrs.get("label"))])
        self.places[tag].append(len(self.open))
        self.open.append(here)
        if not shown:
            return
        if tag == "option" or above.drawn:
            self.page.block(1)
        if tag in BLOCKS and tag not in _CELL:
            self.page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and self._nearest(("li", "td", "th")) == "li") else 1)
        if tag == "br":
            self.page.break_line()
        elif tag == "hr":
            self.page.rows(["---"])
        elif tag == "img" and seen and (attrs.get("alt") or "").strip():
            self.page.flow(attrs["alt"])
        elif tag in ("ol", "ul", "menu", "dir"):
            start = attrs.get("start") or "1"
            here.number = (int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None
        elif tag in ("li", "dd", "blockquote"):
            here.indent, self.page.indent = self.page.indent, (self.page.indent + "  ")[:INDENT]
            if tag == "li":
                owner, mark = self.open[self._innermost(("ol", "ul", "menu", "dir"))], "- "
                if owner.number is not None:
                    mark, owner.number = f"{owner.number}. ", owner.number + 1
                outer = here.indent if self.page.first is None else self.page.first
                self.page.indent, self.page.first = (here.indent + " " * len(mark))[:INDENT], outer[:INDENT] + mark
        elif tag == "table":
            here.grid = Grid()
        elif tag in ("tr", *_CELL, "caption") and (grid := self._grid()) is not None:
            if tag == "tr":
                grid.begin_row()
            else:
                here.holder, self.page = self.page, Page()
                here.columns, here.rows = _whole(attrs.get("colspan"), 1000), _whole(attrs.get("rowspan"), 65534)

    def _choice(self) -> list[list] | None:
        """The options of the innermost open select, if it shows one of them."""
        at = self._innermost(("select",))
        return self.open[at].options if at else None

    def _grid(self) -> Grid | None:
        at = self._innermost(("table",))
        return self.open[at].grid if at else None

    def _close(self) -> None:
        here = self.open.pop()
        self.places[here.tag].pop()
        if here.options:
            selected, usable = [o for o in here.options if o[1]], [o for o in here.options if not o[2]]
            chosen = selected[-1] if selected else usable[0] if usable else None
            if chosen:
                self.page.flow(f" {chosen[0]} ")
        if not here.shown:
            return
        if here.tag == "option" or self.open[-1].drawn:
            self.page.block(1)
        if here.holder is not None:
            lines, self.page = self.page.text().split("\n"), here.holder
            grid = self._grid()
            if here.tag == "caption":
                grid.caption = lines
            else:
                grid.add([] if lines == [""] else lines, here.columns, here.rows)
        elif here.grid is not None:
            self.page.block(2)  # text between the cells came before the table
            lines, padding = here.grid.lines(self.room)
            self.room -= padding
            self.page.rows(lines)
        if here.indent is not None:
            self.page._end()
            self.page.indent, self.page.first = here.indent, None
        if here.tag in BLOCKS and here.tag not in _CELL:
            self.page.block(2 if here.tag in SPACED and not (here.tag in ("ul", "ol") and self._nearest(("li", "td", "th")) == "li") else 1)
        elif here.tag in _CELL and here.holder is None:
            self.page.block(1)

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\f\r"):
            self._close()
        here = self.open[-1]
        if not here.shown and (choice := self._choice()):
            if self._innermost(("option",)) > self._innermost(("select",)) and not choice[-1][3]:
                choice[-1][0] += data
        if here.shown and here.seen and not (here.tag == "details" and here.number == 0):
            (self.page.exact if here.exact else self.page.flow)(data.replace("\r\n", "\n") if here.exact else data)

    def finish(self) -> str:
        while len(self.open) > 1:
            self._close()
        return self.page.text()


def visible_text(html: str) -> str:
    renderer = Renderer(4 * len(html) + 1000)
    renderer.feed(html)
    return renderer.finish()


def extract_text(df: DataFrame, html_column: str = "html", to: str = "text") -> DataFrame:
    """df with the html column replaced by its visible text; a null or empty page gives an empty text.

    Repeated rows give the same text each; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([visible_text(x.as_py()) for x in part.column(1)], pa.string())], ["_row", "_text"])

    rows = beside(df, _html=text_or_empty(html_column))
    made = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())]))
    return made.select(*row_columns(df, (html_column, to)), F.col("_text").alias(to))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
