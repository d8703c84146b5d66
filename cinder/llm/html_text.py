"""HTML extraction by layout-aware rendering.

A tree builder with implied start and end tags folds each element, when it
closes, into its parent's lines: blocks start lines, paragraphs, headings, lists
and tables keep a blank line around them, list items are marked and indented,
table cells are aligned in columns, ``pre`` keeps its spaces, other white space
collapses.  Everything a browser shows as text is emitted (navigation and footers,
``textarea`` and ``xmp`` content, the chosen option of a ``select`` or all options
of a list box, the text of ``svg`` and ``math``); what it does not show is left
out: ``head``, scripts, styles, templates, comments, ``hidden`` elements and
styles that hide, definitions and descriptions of drawings, annotations of
formulas.

Left out by decision: ``noscript`` (pages are taken as with scripts), the fallback
inside ``iframe``, ``audio``, ``video``, ``canvas``, ``noembed``, ``noframes`` and an
``object`` that loads data, suggestions of a ``datalist``, and texts in attributes
(``alt``, ``value``, ``placeholder``, ``title``), style sheets unread.  ``details``
and ``dialog`` count as open.

A ``reversed`` list counts down where it has a ``start``.

No recursion, so depth is no limit, and a tag finds its element by name in a step, so
the time grows with the page and its output; pages are rendered one by one inside Arrow
batches.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noembed noframes xmp iframe textarea title".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe title datalist audio video canvas annotation annotation-xml".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())    # all else ends the head
# In a drawing: what it only defines or describes, and what shows its text.  HTML elements that end an open drawing or formula.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split())
DRAWN_TEXT = frozenset("text foreignobject".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = DRAWN_TEXT | frozenset("desc title annotation-xml mi mo mn ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd tr td th caption thead tbody tfoot center details summary figcaption legend menu dialog hgroup search option textarea".split())
CLOSES_P = (BLOCK - frozenset("html body tr td th caption thead tbody tfoot option legend textarea".split()))
# An element of the key is closed by the start of the listed ones, within the nearest scope element.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
               "tr": ("tr", "td", "th", "caption"), "td": ("td", "th"), "th": ("td", "th"),
               "thead": ("tr", "td", "th", "caption", "thead", "tbody", "tfoot"),
               "tbody": ("tr", "td", "th", "caption", "thead", "tbody", "tfoot"),
               "tfoot": ("tr", "td", "th", "caption", "thead", "tbody", "tfoot")}
# End tags of a table's parts look as far as their table, all others as far as the cell or table around them.
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
CELLS = ("td", "th", "caption", "table")
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_CSS_OPAQUE = re.compile(r"/\*.*?(?:\*/|$)|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?|\([^()]*\)?", re.S)
_SPAN = re.compile(r"\s*(\d{1,3})")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")
_SELECT_END = re.compile(r"<(/?)(?:select|input|textarea|keygen)(?=[\s/>])", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _attributes(rest: str) -> dict[str, str]:
    """Names (lower case) and values of a start tag's attributes; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _style(value: str) -> dict[str, str]:
    """The first word of ``display`` and ``visibility`` as a style attribute sets them: the last one, important ones first."""
    out: dict[str, str] = {}
    firm: set[str] = set()
    for declaration in _CSS_OPAQUE.sub(" ", value).lower().split(";"):
        name, _, rest = declaration.partition(":")
        name, words = name.strip(), rest.replace("!", " !").split()
        if name not in ("display", "visibility") or not words:
            continue
        important = "".join(words).endswith("!important")
        if important or name not in firm:
            out[name] = words[0]
            if important:
                firm.add(name)
    return out


_Cell = tuple[list[str], int, int]           # lines, columns and rows that it spans


class _Box:
    """A block being filled: finished lines, the open line, and what lists and tables need."""

    __slots__ = ("cells", "chosen", "gap", "inline", "item", "lines", "options", "pre", "rows", "span", "step", "tag", "whole")

    def __init__(self, tag: str, pre: bool) -> None:
        self.tag, self.pre = tag, pre
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False                     # a blank line is due before the next line
        self.item = 0                        # of a list: the last item's number; of an item: its own, if given
        self.step = 1
        self.rows: list[list[_Cell]] = []
        self.cells: list[_Cell] = []
        self.span = (1, 1)
        self.options: list[tuple[str, bool, bool]] = []      # of a select: text, chosen, may be chosen unasked
        self.chosen = self.whole = False                     # a list box, or a chosen option; a select with an end tag

    def flush(self) -> None:
        if self.inline:
            text = "".join(self.inline)
            self.inline.clear()
            new = text.split("\n") if self.pre else [s for s in (_SPACE.sub(" ", part).strip(" ") for part in text.split("\0")) if s]
            if any(new):
                self.add(new, False)

    def add(self, lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        if (self.gap or spaced) and self.lines:
            self.lines.append("")
        self.lines += lines
        self.gap = spaced


def _grid(rows: list[list[_Cell]]) -> list[list[tuple[int, list[str], int]]]:
    """Each row's cells as (column, lines, columns): a cell that spans rows keeps later cells out of its columns."""
    out = []
    taken: dict[int, int] = {}               # rows that a column is still covered for
    for row in rows:
        placed, col, below = [], 0, {}
        for lines, span, deep in row:
            while any(taken.get(c, 0) > 0 for c in range(col, col + span)):
                col += 1
            placed.append((col, lines, span))
            if deep > 1:
                below.update(dict.fromkeys(range(col, col + span), deep - 1))
            col += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
        out.append(placed)
    return out


def _table(rows: list[list[_Cell]]) -> list[str]:
    """Cells in aligned columns, two spaces apart; a spanning cell does not widen its columns."""
    grid = _grid(rows)
    width: list[int] = []
    for row in grid:
        for col, lines, span in row:
            width += [0] * (col + span - len(width))
            if span == 1:
                width[col] = max([width[col], *map(len, lines)])
    start = [0]
    for w in width:
        start.append(start[-1] + w + 2)
    out = []
    for row in grid:
        for i in range(max([len(lines) for _, lines, _ in row], default=0)):
            line = ""
            for col, lines, _ in row:
                line = line.ljust(start[col]) if len(line) <= start[col] else line + "  "
                line += lines[i] if i < len(lines) else ""
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    page = page or ""
    root = _Box("root", False)
    boxes = [root]
    opened: list[tuple[str, bool, int, bool]] = []     # tag, has a box, hides (-1: shows again), unseen around it
    places: dict[str, list[int]] = {}                  # where elements of a name stand in ``opened``
    hidden = 0
    drawings: list[bool] = []                          # open svg elements: inside a part that shows text?
    foreign = 0                                        # open svg and math elements
    selects: list[_Box] = []                           # the open select
    next_end: re.Match[str] | None = None              # where the last select seen ends
    unseen = False                                     # by visibility, which an inner element may set again

    def enter(name: str, boxed: bool, hides: int) -> None:
        places.setdefault(name, []).append(len(opened))
        opened.append((name, boxed, hides, unseen))

    def nearest(names: Iterable[str]) -> int:
        """The place of the innermost open element of ``names``; -1 for none."""
        return max([places[n][-1] for n in names if places.get(n)], default=-1)

    def close() -> None:
        nonlocal hidden, unseen, foreign
        tag, boxed, hides, unseen = opened.pop()
        places[tag].pop()
        if hides < 0 and not hidden:
            boxes[-1].inline.append(" ")
        hidden -= hides
        foreign -= tag in ("svg", "math")
        if tag == "svg":
            drawings.pop()
        elif hides < 0:
            drawings[-1] = False
        if not boxed:
            return
        box = boxes.pop()
        if tag == "select":
            selects.pop()
        box.flush()
        if not opened or not hidden:
            place(box, boxes[-1])

    def place(box: _Box, into: _Box) -> None:
        tag, lines = box.tag, box.lines
        if tag in ("td", "th"):
            into.cells.append((lines, *box.span))
        elif tag == "tr":
            box.cells += [(lines, 1, 1)] if lines else []
            into.rows.append(box.cells)
        elif tag in ("thead", "tbody", "tfoot"):
            into.rows += box.rows
            into.add(lines, False)
        elif tag == "table":
            if box.cells:
                box.rows.append(box.cells)
            into.flush()
            into.add(lines + _table(box.rows), True)
        elif tag == "select":
            texts = [text for text, _, _ in box.options]
            if box.chosen:                             # a list box shows them all
                into.flush()
                into.add([text for text in texts if text], False)
            else:
                into.inline += [text for text, chosen, _ in box.options if chosen][-1:] or [
                    text for text, _, free in box.options if free][:1]
        elif tag == "option" and into.tag == "select":
            into.options.append((" ".join(lines), box.chosen, box.whole))
        else:
            if box.rows or box.cells:                  # cells outside a table
                box.add(_table([*box.rows, box.cells] if box.cells else box.rows), False)
            into.flush()
            if tag == "li":
                into.item = box.item if box.step == 0 else into.item + into.step
                mark = f"{into.item}. " if into.tag == "ol" else "- "
                into.add([(mark if i == 0 else " " * len(mark)) + s if s else "" for i, s in enumerate(lines)], False)
            elif tag in ("ul", "ol", "menu") and any(b.tag == "li" for b in boxes[-1:]):
                into.add(lines, False)                 # a nested list stands close to its item
            elif tag in ("dd", "blockquote"):
                into.add(["  " + s if s else "" for s in lines], tag in SPACED)
            else:
                into.add(lines, tag in SPACED)

    def close_to(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the outermost open element of ``tags`` above the nearest of ``scope``, with all in it."""
        floor = nearest(scope)
        above = [places[t][i] for t in tags if places.get(t) and (i := bisect(places[t], floor)) < len(places[t])]
        to = min(above, default=-1)
        while to >= 0 and len(opened) > to:
            close()

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        token = _TOKEN.match(page, lt) if lt >= 0 else None
        end = lt if token else len(page) if lt < 0 else lt + 1
        if end > at and opened and opened[-1][0] == "head" and page[at:end].strip(" \t\n\r\f"):
            close()                                    # text starts the body
        if end > at and selects and boxes[-1] is selects[-1]:
            if not selects[-1].whole and page[at:end].strip():
                close_to(("select",), ())              # never closed: what follows its options is the page
            else:
                at = end                               # a browser shows nothing but options
        if end > at and not hidden and not unseen:
            text = html.unescape(page[at:end])
            boxes[-1].inline.append(text.replace("\0", ""))
        at = end
        if not token:
            continue
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if selects and name not in ("option", "optgroup", "script", "style", "template"):
            if selects[-1].whole and name not in ("select", "input", "textarea", "keygen"):
                continue                               # no other element stands in a select
            if not token[1]:
                close_to(("select",), ())
        if token[1]:                                   # an end tag
            if name == "br":
                if opened and opened[-1][0] == "head":
                    close()
                boxes[-1].inline.append("" if hidden else "\n" if boxes[-1].pre else "\0")
            elif places.get(name) and places[name][-1] >= nearest(("table",) if name in TABLE_PARTS else CELLS):
                to = places[name][-1]                  # an end tag does not reach out of the cell or table around it
                while len(opened) > to:
                    close()
            continue
        rest = token[3] or ""
        if foreign and name in BREAKS_OUT:
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] in HOLDS_HTML or opened[i][0] in BREAKS_OUT or not foreign:
                    break
                if opened[i][0] in ("svg", "math"):
                    while len(opened) > i:
                        close()
        if foreign and rest.endswith("/") and (name in UNDRAWN or name in DRAWN_TEXT or name not in BLOCK):
            continue                                   # closes itself
        if name in CLOSES_P:
            close_to(("p",), ("table", "td", "th", "button", "caption"))
        if name in IMPLIED_END:
            close_to(IMPLIED_END[name], SCOPE.get(name, ("table",)))
        if name == "body":
            close_to(("head",), ())
        elif opened and opened[-1][0] == "head" and name not in IN_HEAD:
            close()                                    # so does any other element
        if name in ("td", "th") and (not opened or opened[-1][0] != "tr"):
            enter("tr", True, 0)                       # implied row
            boxes.append(_Box("tr", False))
        if name in VOID:
            if not hidden:
                if name == "br":
                    boxes[-1].inline.append("\n" if boxes[-1].pre else "\0")
                elif name == "hr":
                    boxes[-1].flush()
                    boxes[-1].gap = True
            continue
        attributes = _attributes(rest) if rest else {}
        style = _style(attributes.get("style", ""))
        hides = int(name in UNSEEN or style.get("display", "none" if "hidden" in attributes else "") == "none"
                    or name == "object" and "data" in attributes)
        if selects and name == "option":
            hides = 0                                  # a closed select shows its choice in any case
        if drawings and not hides:
            if name in UNDRAWN:
                hides = 1
            elif name in DRAWN_TEXT and not drawings[-1]:
                hides, drawings[-1] = -1, True
        if name == "svg":
            hides += 1
            drawings.append(False)
        foreign += name in ("svg", "math")
        if name in RAW and not (foreign and name == "title"):          # its content is no markup
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            content, at = at, stop.start() if stop else len(page)
        boxed = name in BLOCK or name == "select"
        if boxed:
            box = _Box(name, name in ("pre", "xmp", "textarea") or (boxes[-1].pre and not selects))
            if name == "select":
                if not next_end or next_end.start() < at:
                    next_end = _SELECT_END.search(page, at)
                box.whole = bool(next_end and next_end[1])
                rows = re.match(r"\s*(\d+)", attributes.get("size", ""))
                box.chosen = "multiple" in attributes or bool(rows and int(rows[1]) > 1)
                selects.append(box)
            elif name == "option":
                box.chosen, box.whole = "selected" in attributes, "disabled" not in attributes
            if name in ("td", "th"):
                box.span = tuple(max(1, int(m[1]) if (m := _SPAN.match(attributes.get(a, ""))) else 1) for a in ("colspan", "rowspan"))
            elif name == "ol":
                box.step = -1 if "reversed" in attributes and "start" in attributes else 1
                first = _NUMBER.match(attributes.get("start", ""))
                box.item = (int(first[1]) if first else 1) - box.step
            elif name == "li" and (value := _NUMBER.match(attributes.get("value", ""))):
                box.item, box.step = int(value[1]), 0
            boxes.append(box)
        enter(name, boxed, hides)
        hidden += hides
        if "visibility" in style and style["visibility"] in ("hidden", "collapse", "visible"):
            unseen = style["visibility"] != "visible"
        if name in ("textarea", "xmp") and not hidden and not unseen:
            text = page[content:at] if name == "xmp" else html.unescape(page[content:at])
            boxes[-1].inline.append(text.replace("\0", "").replace("\r\n", "\n").removeprefix("\n"))
    while opened:
        close()
    root.flush()
    if root.rows or root.cells:
        root.add(_table([*root.rows, root.cells] if root.cells else root.rows), False)
    return "\n".join(s.rstrip() for s in root.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) for each row of ``pages``.

    Null and empty pages have an empty text and no lines; broken markup is
    closed at the end of the page; repeated rows stay; other columns are not read.
    """
    @F.pandas_udf("string")
    def rendered(page: pd.Series) -> pd.Series:
        return pd.Series([render(p) for p in page], dtype="object")

    return pages.select("page_id", "url", rendered(F.col("html")).alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
