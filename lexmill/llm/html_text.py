"""Visible text of HTML pages, laid out.

The page is cut into tags and text, built into a tree with implied start and end tags, and rendered:
hidden elements give nothing, blocks are set apart, list items get markers and indents, table cells are
aligned in columns (also below cells that span rows), preformatted text keeps its spaces. All visible text
is emitted, that of formulas, drawings and image maps as well.

Defined results: a null or empty page has the empty text; a page without markup gives its own text,
collapsed; unclosed and stray tags are mended as browsers do; cells wider than `widest` are not padded to
(their text stays whole); lists nested deeper than `deepest` are no longer indented, their numbers and marks
stay; the time grows with the length of the page; equal pages give equal texts; only the id and the page are
read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag where it stands; the page is known to hold a `>` behind it.
TAG = re.compile(r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base "
             "param source track area annotation annotation-xml mphantom".split())
FOREIGN = {"svg", "math"}
#: Elements that a drawing holds but does not show where they stand.
UNDRAWN = set("defs metadata desc symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: Elements whose children are set apart by spaces.
GAPPED = set("svg g mfrac mroot msub msup msubsup munder mover munderover mtr".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset form".split())
BLOCKS = PARAGRAPHS | set("address article aside body details dialog dd div dt figcaption footer header hgroup html legend li main menu nav "
                          "option optgroup search section summary tr td th thead tbody tfoot caption center".split())
#: A start tag ends these open elements, unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
#: Elements that an end tag inside them does not close.
WALLS = {"table", "td", "th", "caption", "template", "object"}
#: A block's start tag ends an open paragraph, unless one of these stands between.
AROUND_PARAGRAPHS = WALLS | {"button"} | BLOCKS - {"p"}
THROUGH_WALLS = {"table", "tr", "tbody", "thead", "tfoot", "body"}
IN_HEAD = set("base link meta noscript script style template title".split())
#: Bounds of padding and of indents, unless others are given.
WIDEST, DEEPEST = 40, 20


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        for key, *values in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return unescape("".join(values))
        return None

    def unseen(self) -> bool:
        if self.tag in HIDDEN:
            return True
        if not self.attributes.strip():
            return False
        return self.attribute("hidden") is not None or bool(UNSEEN_STYLE.search(self.attribute("style") or "")) or (
            self.tag == "input" and (self.attribute("type") or "").lower() == "hidden")


class Tree:
    """The open elements of a page and what they hold so far. Where each tag is open is kept, so none is sought element by element."""

    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.foreign = False

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def close(self, at: int) -> None:
        """Closes the open element at a place and all inside it."""
        for element in self.open[at:]:
            self.places[element.tag].pop()
        del self.open[at:]

    def close_through(self, tags: set[str], walls: set[str]) -> None:
        """Closes the outermost open element of these tags above the nearest wall, with all inside it."""
        held = [at for tag in tags if (at := self.places.get(tag))]
        if held:
            wall = self.nearest(walls)
            outermost = min((at[i] for at in held if (i := bisect_right(at, wall)) < len(at)), default=0)
            if outermost:
                self.close(outermost)

    def push(self, tag: str, attributes: str = "", closed: bool = False) -> None:
        element = Element(tag, attributes)
        self.foreign = self.foreign or tag in FOREIGN
        self.open[-1].children.append(element)
        if tag not in VOID and not closed:
            self.places[tag].append(len(self.open))
            self.open.append(element)

    def closes_itself(self, tag: str, attributes: str) -> bool:
        """In drawings and formulas <x/> is a whole element."""
        if not attributes.endswith("/"):
            return False
        return tag in FOREIGN or (self.foreign and self.nearest(FOREIGN) > self.nearest(["foreignobject"]))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.close(len(self.open) - 1)
        if tag in BLOCKS:
            self.close_through({"p"}, AROUND_PARAGRAPHS)
        if tag in ENDS:
            self.close_through(*ENDS[tag])
        holder = self.open[-1].tag
        if tag in ("td", "th") and holder in ("table", "thead", "tbody", "tfoot"):
            self.push("tr")
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        at = self.nearest([tag])
        if at and (tag in THROUGH_WALLS or at >= self.nearest(WALLS)):
            self.close(at)

    def text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self.close(len(self.open) - 1)
        self.open[-1].children.append(text)


def next_tag(page: str, at: int, last: int) -> tuple[int, int, str | None, re.Match | None]:
    """Where the next piece of markup begins and ends, the text of a CDATA section, and the match of a tag. last: place of the last `>`."""
    start = page.find("<", at)
    while start >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(page), None, None
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            return start, end + 3 if end >= 0 else len(page), page[start + 9:end if end >= 0 else len(page)], None
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            return start, end + 1 if end >= 0 else len(page), None, None
        if start < last and (m := TAG.match(page, start)):
            return start, m.end(), None, m
        start = page.find("<", start + 1)
    return len(page), len(page), None, None


def parse(page: str) -> Element:
    tree, at, last = Tree(), 0, page.rfind(">")
    while at < len(page):
        start, end, cdata, m = next_tag(page, at, last)
        if start > at:
            tree.text(unescape(page[at:start]))
        at = end
        if cdata is not None:
            tree.text(cdata)
        elif m:
            tag = m["tag"].lower()
            if m["end"]:
                tree.end(tag)
            elif tree.closes_itself(tag, m["attributes"]):
                tree.push(tag, m["attributes"], closed=True)
            else:
                tree.start(tag, m["attributes"])
                if tag in RAW:
                    closing = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at, last + 1)
                    body = page[at:closing.start() if closing else len(page)]
                    tree.text(unescape(body) if tag in ("textarea", "title") else body)
                    tree.end(tag)
                    at = closing.end() if closing else len(page)
    return tree.root


class Lines:
    """Text being laid out: finished lines, the line in the making and the gap asked for before the next one.

    Items and quotes are levels of the same lines. A level's mark stands before its first line, its rest (blanks or a quote
    mark) before the others; from level `deepest` on blanks are left out, marks never. Gaps asked for inside a level before
    its first line or after its last do not count.
    """

    def __init__(self, deepest: int):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.deepest = deepest
        self.levels: list[tuple[str, str, int]] = []  # mark, rest, gap before
        self.fresh = self.unmarked = 0  # levels from here on have no line, no mark yet
        self.deep_quotes = 0  # marked quotes below the deepest indented level

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or bool(text and self.line)
            return
        if self.line and (self.space or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = text[-1].isspace()

    def end_line(self, gap: int = 0) -> None:
        if self.line:
            self.add("".join(self.line))
        self.line, self.space = [], False
        self.gap = max(self.gap, gap)

    def begin_level(self, mark: str, rest: str) -> None:
        self.levels.append((mark, rest, self.gap))
        self.gap = 0

    def end_level(self) -> None:
        self.end_line()
        mark, rest, gap = self.levels.pop()
        level = len(self.levels)
        if level < self.unmarked and level >= self.deepest and rest.strip():
            self.deep_quotes -= 1
        self.gap = gap if level >= self.fresh else 0
        self.fresh, self.unmarked = min(self.fresh, level), min(self.unmarked, level)

    def add(self, line: str) -> None:
        gap = self.levels[self.fresh][2] if self.fresh < len(self.levels) else self.gap
        if self.done:
            self.done += [""] * gap
        self.gap, self.fresh = 0, len(self.levels)
        self.done.append(self.prefix() + line if line else line)

    def prefix(self) -> str:
        marked, self.unmarked = self.unmarked, len(self.levels)
        if not self.levels:
            return ""
        rests = [rest for _, rest, _ in self.levels[:min(marked, self.deepest)]]
        marks = [mark for mark, _, _ in self.levels[marked:]]
        before = "".join(rests) + "> " * self.deep_quotes + "".join(marks)
        self.deep_quotes += sum(bool(rest.strip()) for _, rest, _ in self.levels[max(marked, self.deepest):])
        return before

    def kept(self, text: str) -> None:
        """Preformatted text, line by line."""
        first, *rest = text.split("\n")
        self.line.append(first)
        for line in rest:
            self.add("".join(self.line).rstrip())
            self.line = [line]

    def finish(self) -> list[str]:
        self.end_line()
        return self.done


def aligned(rows: list[tuple[list[tuple[int, list[str]]], int]], widest: int) -> list[str]:
    """Rows of (column, lines) cells and the column where each row ends -> table lines with columns of common widths.

    Columns in which no cell begins are laid out as one, so a cell over very many columns takes no room for them.
    """
    begun = sorted({c for cells, _ in rows for c, _ in cells})
    behind = [*begun[1:], max((end for _, end in rows), default=0)]
    columns = [c for a, b in zip(begun, behind) for c in ((a, a + 1) if a + 1 < b else (a,))]
    widths = dict.fromkeys(columns, 0)
    for cells, _ in rows:
        for c, lines in cells:
            widths[c] = max([widths[c], *[len(line) for line in lines if len(line) <= widest]])
    out = []
    for cells, end in rows:
        held = dict(cells)
        shown = columns[:bisect_left(columns, end)]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            out.append(" | ".join((held[c][k] if c in held and k < len(held[c]) else "").ljust(widths[c]) for c in shown).rstrip())
    return out


def number(element: Element, name: str, least: int, default: int, most: int = 1000) -> int:
    value = (element.attribute(name) or "").strip()
    return max(least, min(int(value), most)) if value.isascii() and value.isdigit() else default


class Table:
    """Rows of cells, with the columns that cells of rows above still fill."""

    MOST_ROWS = 65534

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.ends: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # first column, column behind, rows left
        self.filled: list[tuple[int, int]] = []

    def group(self) -> None:
        self.spans = []

    def row(self) -> None:
        self.rows.append([])
        self.ends.append(0)
        self.filled = [(a, b) for a, b, _ in sorted(self.spans, reverse=True)]
        self.spans = [(a, b, n - 1) for a, b, n in self.spans if n > 1]

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at = self.ends[-1]
        while self.filled and self.filled[-1][0] <= at:
            at = max(at, self.filled.pop()[1])
        if rows != 1:
            self.spans.append((at, at + columns, (rows or self.MOST_ROWS) - 1))
        self.rows[-1].append((at, lines))
        self.ends[-1] = at + columns


class Page:
    """Walks a tree without recursion: `enter` and `leave` of each element, over a stack of text under layout."""

    def __init__(self, widest: int = WIDEST, deepest: int = DEEPEST):
        self.widest, self.deepest = widest, deepest
        self.layout = [Lines(deepest)]
        self.lists: list[list] = []
        self.tables: list[Table] = []
        self.pre = 0
        self.drawings = 0

    def render(self, root: Element) -> str:
        todo: list[tuple[str, object]] = [("enter", root)]
        while todo:
            step, node = todo.pop()
            if isinstance(node, str):
                (self.layout[-1].kept if self.pre else self.layout[-1].text)(node)
            elif step == "leave":
                self.leave(node)
            elif not node.unseen() and not (self.drawings and node.tag in UNDRAWN):
                self.enter(node)
                todo.append(("leave", node))
                for child in reversed(node.children):
                    todo.append(("enter", child))
                    if node.tag in GAPPED:
                        todo.append(("enter", " "))
        return "\n".join(self.layout[0].finish()).strip("\n")

    def enter(self, e: Element) -> None:
        now, tag = self.layout[-1], e.tag
        if tag in BLOCKS:
            now.end_line(1 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists) else 0)
        if tag == "br":
            if now.line or now.gap:
                now.end_line()
            else:
                now.gap = 1
        elif tag == "hr":
            now.end_line()
            now.add("---")
        elif tag in ("img", "input"):
            now.text(e.attribute("alt" if tag == "img" else "value") or "")
        elif tag in ("ul", "ol", "menu"):
            self.lists.append([tag, number(e, "start", 0, 1)])
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in ("thead", "tbody", "tfoot") and self.tables:
            self.tables[-1].group()
        elif tag == "svg":
            self.drawings += 1
        elif tag == "pre":
            self.pre += 1
        if tag == "li":
            marker = self.marker()
            now.begin_level(marker, " " * len(marker))
        elif tag == "blockquote":
            now.begin_level("> ", "> ")
        elif tag in ("td", "th"):
            self.layout.append(Lines(self.deepest))

    def leave(self, e: Element) -> None:
        tag = e.tag
        if tag in ("td", "th"):
            inner = self.layout.pop().finish()
            if self.tables:
                self.tables[-1].cell(inner, number(e, "colspan", 1, 1), number(e, "rowspan", 0, 1, Table.MOST_ROWS))
            else:
                for line in inner:
                    self.layout[-1].add(line)
        now = self.layout[-1]
        if tag in ("li", "blockquote"):
            now.end_level()
        if tag == "table":
            made = self.tables.pop()
            for line in aligned(list(zip(made.rows, made.ends)), self.widest):
                now.add(line)
        elif tag in ("ul", "ol", "menu"):
            self.lists.pop()
        elif tag == "pre":
            now.end_line()
            self.pre -= 1
        elif tag == "svg":
            self.drawings -= 1
        if tag in BLOCKS:
            now.end_line(1 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists) else 0)

    def marker(self) -> str:
        if not self.lists or self.lists[-1][0] != "ol":
            return "- "
        self.lists[-1][1] += 1
        return f"{self.lists[-1][1] - 1}. "


def visible_text(page: str | None, widest: int = WIDEST, deepest: int = DEEPEST) -> str:
    return Page(widest, deepest).render(parse(page)) if page else ""


def text_rows(widest: int, deepest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = pd.Series([visible_text(p, widest, deepest) for p in batch["html"]], dtype=object)
            yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "text": texts, "n_chars": texts.str.len().astype("int64")})
    return run


def extract(pages: DataFrame, id_column: str = "page_id", html: str = "html", widest: int = WIDEST, deepest: int = DEEPEST) -> DataFrame:
    """One row per page: page_id, text and n_chars."""
    kind = pages.select(id_column).schema[0].dataType.simpleString()
    return pages.select(F.col(id_column).alias("page_id"), F.col(html).alias("html")).mapInPandas(
        text_rows(widest, deepest), f"page_id {kind}, text string, n_chars long")
