"""Operator 5: the visible text of web pages, laid out as a browser without styles would."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALIGN = 60  # characters to which a column of a table may grow; what stands behind a wider cell goes below it

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=[ \t\n\r\f]*+(?:"[^"]*"|'[^']*')?)*+)>|[!?/][^>]*>)""", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]|<[!?/]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_GAPS = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"^([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?$")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Text up to the end tag, in which tags are not tags.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist rp base link meta".split())
#: Blank lines around each block.
BLOCKS = dict.fromkeys("address article aside body center details dialog dir div dt dd fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section summary tr caption textarea".split(), 0) | dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul xmp".split(), 1)
CLOSES_P = (frozenset(BLOCKS) - frozenset("body dt dd html legend li option optgroup tr caption textarea".split())) | {"plaintext"}
_CELL = frozenset(("td", "th"))
_GROUP = frozenset(("thead", "tbody", "tfoot", "colgroup", "caption"))
#: Start tag: (elements it ends, elements that shield what is around them).
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELL | {"caption"}, frozenset(("table",))),
    "th": (_CELL | {"caption"}, frozenset(("table",))),
    "tr": (_CELL | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot", "colgroup", "caption"), (_CELL | _GROUP | {"tr"}, frozenset(("table",)))),
    "body": (frozenset(("head",)), frozenset()),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
}
_SHIELD = frozenset(("table", "td", "th", "caption", "html", "template", "button", "object"))
_HEAD_CONTENT = frozenset("title meta link style script base noscript template basefont bgsound".split())


class _Kept(str):
    """A blank line of preformatted text."""


def _last(pattern: re.Pattern, style: str) -> str | None:
    """The last value that declarations give a property."""
    found = pattern.findall(style)
    return found[-1].lower() if found else None


def rules(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules of a style sheet that hold on any screen.

    Blocks of @media count if they name a screen or all media without further
    conditions; those of other at-rules don't, but for @layer.
    """
    css = _COMMENT.sub(" ", css)
    found, heads, at = [], [], 0
    for m in _BRACE.finditer(css):
        part = css[at : m.start()]
        at = m.end()
        if m[0] == "{":
            heads.append(part.rpartition(";")[2].strip())
        elif heads:
            head = heads.pop()
            if not head.startswith("@") and all(map(_holds, heads)):
                found.append((head, part))
    return found


def _holds(head: str) -> bool:
    name, _, condition = head.lower().partition(" ")
    return name == "@layer" or name == "@media" and any(x.strip() in ("", "all", "screen", "only screen") for x in condition.split(","))


class _Flow:
    """Lines of one box: the page or a table cell."""

    __slots__ = ("lines", "line", "space", "blank", "prefix", "marker")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        parts = _GAPS.sub(" ", s)
        if parts == " ":
            self.space = bool(self.line)
            return
        if self.line:
            if self.space or parts[0] == " ":
                self.line.append(" ")
        self.line.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def verbatim(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.end(True, True)
            if x:
                self.line.append(x)
        self.space = False

    def end(self, forced: bool = False, kept: bool = False) -> None:
        """End the line; an empty one counts only if forced, and one that is kept is never left out."""
        if self.line or forced:
            if self.blank and self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
            indent = "".join(self.prefix)
            if self.marker:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            line = (indent + "".join(self.line)).rstrip()
            self.lines.append(_Kept() if kept and not line else line)
            self.line = []
        self.space = False

    def block(self, margin: int) -> None:
        self.end()
        if margin > self.blank:
            self.blank = margin

    def done(self) -> list[str]:
        self.end()
        return self.lines


class _Table:
    """Rows of (lines, colspan, rowspan)."""

    __slots__ = ("rows",)

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def layout(self) -> list[str]:
        placed, widths, busy = [], [], {}  # busy: column -> rows it is taken for
        for row in self.rows:
            at, out = 0, []
            for lines, columns, rows in row:
                while busy.get(at, 0):
                    at += 1
                out.append((at, columns, lines))
                if rows > 1:
                    for c in range(at, at + columns):
                        busy[c] = rows
                at += columns
            placed.append(out)
            busy = {c: n - 1 for c, n in busy.items() if n > 1}
            widths += [0] * (at - len(widths))
            for c, columns, lines in out:
                if columns == 1:
                    widths[c] = max(widths[c], min(ALIGN, max(map(len, lines), default=0)))
        for out in placed:
            for c, columns, lines in out:
                if columns > 1:
                    need = min(ALIGN, max(map(len, lines), default=0)) - sum(widths[c : c + columns]) - 2 * (columns - 1)
                    if need > 0:
                        widths[c + columns - 1] += need
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + (w + 2 if w else 0))
        text: list[str] = []
        for out in placed:
            begin = 0
            for k, (c, columns, lines) in enumerate(out):
                # a cell that is wider than its columns ends a band; the next stands below, in its column
                if k + 1 == len(out) or max(map(len, lines), default=0) > max(0, starts[c + columns] - starts[c] - 2):
                    text += self.band(out[begin : k + 1], starts)
                    begin = k + 1
        return text

    @staticmethod
    def band(cells: list[tuple[int, int, list[str]]], starts: list[int]) -> list[str]:
        """Lines of cells side by side."""
        text: list[str] = []
        for i in range(max(len(lines) for _, _, lines in cells)):
            line, kept = "", False
            for c, _, lines in cells:
                if i < len(lines):
                    kept = kept or isinstance(lines[i], _Kept)
                    if lines[i]:
                        line = line.ljust(starts[c]) + lines[i]
            line = line.rstrip()
            text.append(_Kept() if kept and not line else line)
        return text


def _attributes(s: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(s):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def _number(s: str | None, least: int, most: int) -> int | None:
    m = re.match(r"\s*(-?)(?=\d)0*(\d*)", s or "")
    if not m:
        return None
    # beyond 18 digits a number is out of any range
    return min(max(int(m[1] + (m[2][:18] or "0")), least), most)


class _Page:
    def __init__(self):
        self.flow = _Flow()
        self.outer: list[tuple] = []  # (flow, table, row) around each open cell or caption
        self.table: list[_Table] = []
        #: Open elements: tag, shown before it, visible before it, what to undo.
        self.open: list[tuple] = []
        self.count: dict[str, int] = {}
        self.shown = True
        self.visible = True
        self.pre = 0
        self.lists: list[list] = []
        #: Selector of a style sheet: place of its last rule, display and visibility, or None.
        self.hiding: dict[str, tuple] = {}
        self.order = 0

    def style(self, css: str) -> None:
        for head, declarations in rules(css):
            display, visibility = _last(_DISPLAY, declarations), _last(_VISIBILITY, declarations)
            if display is None and visibility is None:
                continue
            for selector in head.split(","):
                s = _SIMPLE.match(selector.strip())
                if s and selector.strip():
                    # of equally specific rules the last holds
                    self.order += 1
                    name = f"{(s[1] or '').lower()}{s[2] or ''}{s[3] or ''}"
                    before = self.hiding.get(name, (0, None, None))
                    self.hiding[name] = (self.order, before[1] if display is None else display, before[2] if visibility is None else visibility)

    def hidden(self, tag: str, a: dict[str, str]) -> bool:
        """Whether an element isn't shown, by its attributes and the simple rules of style sheets, the most specific last."""
        gone = "hidden" in a or (tag == "dialog" and "open" not in a)
        veiled = False
        if self.hiding:
            classes = [f".{c}" for c in a.get("class", "").split()]
            ids = [f"#{a['id']}"] if "id" in a else []
            for names in ([tag], classes, [tag + c for c in classes], ids, [tag + i for i in ids]):
                for _, display, visibility in sorted(self.hiding[n] for n in names if n in self.hiding):
                    gone = gone if display is None else display == "none"
                    veiled = veiled if visibility is None else visibility != "visible"
        if style := a.get("style"):
            if (display := _last(_DISPLAY, style)) is not None:
                gone = display == "none"
            if _last(_VISIBILITY, style) is not None:
                veiled = False  # the element's own state, which its children can change
        return gone or veiled

    def within(self, tags: frozenset, shields: frozenset) -> int | None:
        """Index of the innermost open element of tags that no shield hides."""
        if not any(self.count.get(t) for t in tags):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in tags:
                return i
            if tag in shields:
                return None
        return None

    def pop_to(self, i: int) -> None:
        while len(self.open) > i:
            self.close()

    def start(self, tag: str, attributes: str) -> None:
        if self.count.get("head") and tag not in _HEAD_CONTENT and tag not in ("head", "html"):
            i = self.within(frozenset(("head",)), frozenset())
            self.pop_to(i)
        if tag in ("html", "body", "head") and self.count.get(tag):
            return
        if tag in IMPLIED:
            ends, shields = IMPLIED[tag]
            while (i := self.within(ends, shields)) is not None:
                self.pop_to(i)
        if tag in CLOSES_P and self.count.get("p") and (i := self.within(frozenset(("p",)), _SHIELD)) is not None:
            self.pop_to(i)
        if tag in _CELL and self.table and self.within(frozenset(("tr",)), frozenset(("table",))) is None:
            self.push("tr", {})
        self.push(tag, _attributes(attributes) if attributes.strip(" /\n\t") else {})

    def push(self, tag: str, a: dict[str, str]) -> None:
        shown, visible, undo = self.shown, self.visible, None
        parent = self.open[-1] if self.open else None
        if tag == "summary" and parent and parent[3] == "closed":
            self.shown = parent[1]
        if tag in UNSEEN or (a or self.hiding or tag == "dialog") and self.hidden(tag, a):
            self.shown = False
        if (s := a.get("style")) and (v := _last(_VISIBILITY, s)):
            self.visible = v == "visible"
        if self.shown:
            flow = self.flow
            if tag == "br":
                flow.end(True)
            elif tag == "wbr":
                pass
            elif tag == "input":
                if self.visible and a.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "range", "color", "image") and a.get("value"):
                    flow.text(a["value"])
            elif tag == "table":
                flow.block(1)
                self.table.append(_Table())
                undo = "table"
            elif tag == "tr" and self.table:
                self.table[-1].rows.append([])
                undo = "tr"
            elif tag in _CELL and self.table and self.table[-1].rows:
                self.outer.append((flow, self.pre, self.lists, self.table))
                self.flow, self.pre, self.lists, self.table = _Flow(), 0, [], []
                undo = ("cell", _number(a.get("colspan"), 1, 1000) or 1, _number(a.get("rowspan"), 1, 65534) or 1)
            elif tag in BLOCKS:
                flow.block(0 if BLOCKS[tag] and tag in ("ul", "ol", "menu") and self.lists else BLOCKS[tag])
                if tag in ("ul", "ol", "menu", "dir"):
                    self.lists.append([tag == "ol", _number(a.get("start"), -(10**9), 10**9) if "start" in a else 1])
                    undo = "list"
                elif tag == "li":
                    bullet = "- "
                    if self.lists and self.lists[-1][0]:
                        own = _number(a.get("value"), -(10**9), 10**9)
                        n = own if own is not None else (self.lists[-1][1] or 0)
                        self.lists[-1][1] = n + 1
                        bullet = f"{n}. "
                    flow.marker = bullet
                    flow.prefix.append(" " * len(bullet))
                    undo = "indent"
                elif tag in ("dd", "blockquote"):
                    flow.prefix.append("    " if tag == "dd" else "  ")
                    undo = "indent"
                elif tag in ("pre", "listing", "xmp", "textarea"):
                    self.pre += 1
                    undo = "pre"
                elif tag == "details" and "open" not in a:
                    undo = "closed"
        if tag in VOID:
            if tag in BLOCKS and self.shown:
                self.flow.block(BLOCKS[tag])
            self.shown, self.visible = shown, visible
            return
        self.open.append((tag, shown, visible, undo))
        self.count[tag] = self.count.get(tag, 0) + 1
        if undo == "closed":
            self.open[-1] = (tag, shown, visible, "closed")
            self.shown = False

    def close(self) -> None:
        tag, shown, visible, undo = self.open.pop()
        self.count[tag] -= 1
        if undo == "closed":
            self.shown = shown
        if isinstance(undo, tuple):
            cell = self.flow.done()
            self.flow, self.pre, self.lists, self.table = self.outer.pop()
            self.table[-1].rows[-1].append((cell, undo[1], undo[2]))
        elif undo == "table":
            lines = self.table.pop().layout()
            self.flow.block(1)
            for line in lines:
                if line or isinstance(line, _Kept):
                    self.flow.line.append(line)
                    self.flow.end(kept=isinstance(line, _Kept))
            self.flow.block(1)
        elif undo == "list":
            self.lists.pop()
            self.flow.block(0 if self.lists else 1)
        elif undo == "indent":
            self.flow.end()
            self.flow.prefix.pop()
            self.flow.marker = ""
            self.flow.block(BLOCKS[tag])
        elif self.shown and tag in BLOCKS and undo != "tr":
            self.flow.block(0 if tag in ("ul", "ol", "menu") and self.lists else BLOCKS[tag])
            if undo == "pre":
                self.pre -= 1
        self.shown, self.visible = shown, visible

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.count.get(tag):
            self.start(tag, "")
            if tag == "p":
                self.close()
            return
        if not self.count.get(tag) or tag in ("body", "html"):
            return
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
            i = self.within(frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), _SHIELD)
        elif tag in ("table", "template", "td", "th", "caption", "button", "object"):
            i = self.within(frozenset((tag,)), frozenset() if tag == "table" else frozenset(("table",)))
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            i = self.within(frozenset((tag,)), frozenset(("table",)))
        else:
            i = self.within(frozenset((tag,)), _SHIELD)
        if i is not None:
            self.pop_to(i)

    def text(self, s: str) -> None:
        if not self.shown or not self.visible:
            return
        if "&" in s:
            s = html.unescape(s)
        if self.pre:
            self.flow.verbatim(s)
        elif s:
            self.flow.text(s)


def render(page: str) -> str:
    """The visible text of one page; see extract."""
    out, at, begin = _Page(), 0, 0
    n = len(page)
    while at < n:
        at = page.find("<", at)
        m = _TAG.match(page, at) if at >= 0 else None
        if m is None:
            if at >= 0 and not _OPENS.match(page, at):
                at += 1
                continue
            # what begins as a tag and never ends has no tag behind it either
            break
        if at > begin:
            out.text(page[begin:at])
        at = begin = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, m[3])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            inside = page[at : stop.start()] if stop else page[at:]
            if tag == "style":
                out.style(inside)
            elif tag in ("textarea", "xmp"):
                out.text(inside.replace("&", "&amp;") if tag == "xmp" else inside)
            out.end(tag)
            at = stop.end() if stop else n
        elif tag in ("pre", "listing") and page.startswith("\n", at):
            at += 1
        begin = at
    if begin < n:
        out.text(page[begin:])
    out.pop_to(0)
    # of blank lines in a row one stays, but for those of preformatted text
    lines: list[str] = []
    for line in out.flow.done():
        if line or isinstance(line, _Kept) or not lines or lines[-1] or isinstance(lines[-1], _Kept):
            lines.append(line)
    return "\n".join(lines).replace("\xa0", " ").strip("\n")


@F.pandas_udf(StringType())
def _rendered(pages: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else render(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages.

    The tree builder implies missing tags: a paragraph ends where a block
    begins, list items, cells, rows, options and terms end where the next
    begins, cells outside a row open one, and what isn't closed ends with its
    parent.  Text is visible unless it is in the head, a script, a style, a
    template, an embedded object's fallback, an element that is hidden by
    its attribute, its style or a simple rule of the page's style sheets (a
    tag, class or id), a closed dialog, or a closed details element outside its
    summary.  White space collapses except in preformatted text; blocks start
    lines, and paragraphs, headings, lists, quotes and tables have a blank line
    around them; list items have bullets or their numbers, nested lists are
    indented; cells of a table stand in columns, with spans of rows and
    columns.  A column grows to 60 characters; where a cell is wider, what
    follows in its row stands below it, each cell in its own column, and no
    text is cut.  Blank lines collapse into one, but not those of preformatted
    text.  Values of input fields are visible, all options of a selection too.
    Of rules for an element the most specific holds, of equally specific ones
    the last, and its own style before all; blocks of @media count only if
    they are for any screen.

    A null page gives null, an empty one the empty text.  Broken markup is
    text, and so is all behind a tag that never ends.  The time that a page
    takes grows with its length.  Repeated rows each have a result, null ids and addresses stay.
    Other columns are ignored.  No pages, no rows.
    """
    return pages.select("page_id", "url", _rendered("html").alias("text"))
