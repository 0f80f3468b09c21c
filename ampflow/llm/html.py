"""HTML to text, laid out as it would be seen.

A tree builder reads the tags, with the end tags and table rows that HTML
implies; a walk over the tree leaves out what is not visible and lays out the
rest: paragraphs and headings stand apart, list items get bullets or numbers
and are indented, table cells are aligned in columns, preformatted text keeps
its spaces.

A null page gives a null text, an empty one an empty text.  Markup that never
ends is text, as is a ``<`` that opens no tag.  Repeated rows give repeated
rows, an empty table an empty one.  Nothing recurses, and where open elements
stand is kept by their names, so work is linear in a page whatever its depth;
only the lines of tables within tables are laid out once a level.

Unseen are elements that show nothing by their kind, ``hidden`` ones, and those
that ``display: none`` or ``visibility`` hides, by their own style or by a style
sheet's rules for a tag, a class or an id (or a tag with one); ``visibility`` is
inherited, so a visible child of a hidden element is seen.  Rules under
conditions (``@media``) and with longer selectors are not applied.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist meta link base param source track area map".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main menu nav option optgroup section select summary caption tbody thead tfoot tr td th".split())
CLOSES_P = BLOCKS - frozenset("html body li dd dt option optgroup summary caption legend tbody thead tfoot tr td th select".split()) | frozenset(["li", "dd", "dt"])
#: An open element of the key's kind ends where one of these begins; the search stops at the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)),
}
_WALLS = frozenset(["td", "th", "caption", "table"])
#: End tags that reach beyond a wall.
_PASSING = frozenset("table tr tbody thead tfoot body html".split())
_TAG = re.compile(r"""<!--.*?-->|<!--.*\Z|<[!?][^>]*>|</\s*([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
#: All that is left of it where no ``>`` follows.
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
_NOTES = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Both are tried at the start of a run only: what fails there fails at each later place of it.
_AT_RULE = re.compile(r"(?<![^{};])([^{};@]*+)@[^{};]*+(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"(?<![^{}])([^{}]++)\{([^{}]*+)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])(-?[_a-z][\w-]*))?\Z", re.I)
#: Columns to which lists indent and to which a table's column is widened, at most: longer cells push what follows to the right.
DEEP, WIDE = 80, 100
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(page: str) -> Node:
    """The tree of a page: nodes and, among their children, strings."""
    root = Node("#root", {})
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of each tag: where it is open in the stack

    def last(tags: tuple[str, ...] | frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(upto: int) -> None:
        for node in stack[upto:]:
            places[node.tag].pop()
        del stack[upto:]

    def end(kinds: tuple[str, ...], stop: tuple[str, ...] | frozenset) -> None:
        found = last(kinds)
        if found > last(stop):
            close(found)

    def put(node: Node) -> None:
        stack[-1].children.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    size, closed = len(page), page.rfind(">")
    while at < size:
        m = (_TAG if at <= closed else _OPEN_COMMENT).search(page, at)
        if not m:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m.lastindex is None:
            continue  # a comment or a declaration
        if m[1]:
            tag = m[1].lower()
            found, wall = last((tag,)), 0 if tag in _PASSING else last(_WALLS)
            if found and found >= wall:
                close(found)
            elif not wall and tag in ("p", "br"):
                stack[-1].children.append(Node(tag, {}))
        elif m[2]:
            tag = m[2].lower()
            attrs = {a.lower(): html.unescape(v.strip("\"'")) for a, v in _ATTR.findall(m[3])} if m[3] else {}
            if tag in CLOSES_P:
                end(("p",), _WALLS)
            if len(stack) > 1 and stack[-1].tag == "head" and tag not in UNSEEN:
                close(len(stack) - 1)
            if tag in IMPLIED:
                end(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag != "tr" and places.get("table"):
                put(Node("tr", {}))
            if tag in VOID:
                stack[-1].children.append(Node(tag, attrs))
            elif tag in RAW:
                node = Node(tag, attrs)
                stack[-1].children.append(node)
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                inner = page[at : stop.start()] if stop else page[at:]
                node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
                at = stop.end() if stop else size
            else:
                put(Node(tag, attrs))
    return root


def _declared(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _STYLE.findall(style)}


def sheet(root: Node) -> dict[tuple[str, str, str], dict[str, str]]:
    """What a page's style elements say of display and visibility: (tag, ``.`` or ``#``, name) to declarations."""
    out: dict[tuple[str, str, str], dict[str, str]] = {}
    work: list = [root]
    while work:
        node = work.pop()
        if node.tag == "style":
            rules = _AT_RULE.sub(r"\1", _NOTES.sub("", "".join(node.children)))
            for selectors, body in _RULE.findall(rules):
                said = _declared(body)
                for one in selectors.split(",") if said else ():
                    m = _SIMPLE.match(one.strip())
                    if m and m[0]:
                        out.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {}).update(said)
        else:
            work.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def styled(node: Node, rules: dict) -> dict[str, str]:
    """An element's display and visibility, as far as they are set: by its tag, then classes, then id, then itself."""
    a, out = node.attrs, {}
    if rules:
        names = [("", "")] + [(".", c) for c in a.get("class", "").split()] + [("#", a.get("id", ""))]
        for sign, name in names:
            for tag in ("", node.tag):
                out.update(rules.get((tag, sign, name), {}))
    if "style" in a:
        out.update(_declared(a["style"]))
    return out


def visible(node: Node, style: dict[str, str]) -> bool:
    """Whether an element takes part in the page, going by itself."""
    if node.tag in UNSEEN or style.get("display") == "none":
        return False
    a = node.attrs
    if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not (node.tag == "dialog" and "open" not in a)


class _Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.gap = 0
        self.indent = ""
        self.bullet = ""

    def flush(self, gap: int = 0) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip(" ")
        self.text = []
        if line:
            self.line(line)
        self.gap = max(self.gap, gap)

    def line(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(f"{self.indent}{self.bullet}{line}".rstrip())
        if self.bullet:
            self.deepen(len(self.bullet))
            self.bullet = ""

    def block(self, lines: list[str]) -> None:
        """Lines that were laid out, as ``line`` would put one after another."""
        if self.indent or self.bullet:
            for line in lines:
                self.line(line)
        elif lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def deepen(self, columns: int) -> None:
        self.indent = " " * min(len(self.indent) + columns, DEEP)


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines of a cell, columns and rows it spans) with their columns aligned."""
    if all(len(row) < 2 and all(across == down == 1 for _, across, down in row) for row in rows):
        out: list[str] = []  # one column
        for row in rows:
            for lines, _, _ in row:
                out += lines
        return out
    placed, width = [], {}
    taken: dict[int, tuple[int, int]] = {}  # first column of a cell that spans rows: the row after it, its columns
    for r, row in enumerate(rows):
        at, cells = 0, []
        for lines, across, down in row:
            while taken.get(at, (0, 0))[0] > r:
                at += taken[at][1]
            width[at] = max([width.get(at, 0), *(min(len(x), WIDE) for x in lines if across == 1)])
            if down > 1:
                taken[at] = (r + down, across)
            cells.append((at, lines))
            at += across
        placed.append(cells)
    start, x = {}, 0
    for column in sorted(width):
        start[column] = x
        x += width[column] + 2
    out = []
    for cells in placed:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            parts, size = [], 0
            for at, lines in cells:
                if i < len(lines) and lines[i]:
                    pad = max(start[at] - size, 2 if size else 0)
                    parts += [" " * pad, lines[i]]
                    size += pad + len(lines[i])
            out.append("".join(parts))
    return out


def _span(node: Node, name: str, most: int) -> int:
    """Columns or rows that a cell spans; no rows said to be 0 means all that follow."""
    said = node.attrs.get(name, "1").strip()
    if not (said.isascii() and said.isdigit() and len(said) < 6):
        return 1
    return most if name == "rowspan" and int(said) == 0 else min(max(int(said), 1), most)


def _trimmed(lines: list[str]) -> list[str]:
    """Without empty lines at either end."""
    first, last = 0, len(lines)
    while first < last and not lines[first].strip():
        first += 1
    while first < last and not lines[last - 1].strip():
        last -= 1
    return lines[first:last]


def render(root: Node) -> str:
    """The visible text of a tree, laid out."""
    page = _Page()
    pages: list[_Page] = []  # outer pages of table cells
    tables: list[list] = []  # rows of open tables
    lists: list[int | None] = []  # next number of open lists; None for bullets
    indents: list[str] = []
    pre = 0
    rules = sheet(root)
    shown = [True]  # by visibility, which is inherited
    work: list = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            if not shown[-1]:
                continue
            if pre:
                first, *rest = node.split("\n")
                page.text.append(first)
                for more in rest:
                    page.line("".join(page.text)) if page.text and "".join(page.text).strip() else page.lines.append("")
                    page.text = [more]
            else:
                page.text.append(node)
            continue
        tag = node.tag
        if not leaving:
            style = styled(node, rules)
            if not visible(node, style):
                continue
            if tag == "br":
                if shown[-1]:
                    page.flush()
                continue
            if tag in VOID and tag != "hr":
                continue
            seen = style.get("visibility")
            shown.append(seen == "visible" if seen in ("visible", "hidden", "collapse") else shown[-1])
            if tag in ("td", "th") and tables:
                page.flush()
                pages.append(page)
                page = _Page()
            elif tag in BLOCKS:
                page.flush(1 if tag in PARAGRAPHS and not (lists and tag in ("ul", "ol", "dl")) else 0)
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                indents.append(page.indent)
                if lists and lists[-1] is not None:
                    page.bullet = f"{lists[-1]}. "
                    lists[-1] += 1
                else:
                    page.bullet = "- "
            elif tag in ("dd", "blockquote"):
                indents.append(page.indent)
                page.deepen(2)
            elif tag == "pre":
                pre += 1
            work.append((node, True))
            shut = tag == "details" and "open" not in node.attrs
            for child in reversed(node.children):
                if not shut or isinstance(child, Node) and child.tag == "summary":
                    work.append((child, False) if isinstance(child, Node) else (child, None))
            continue
        shown.pop()
        if tag == "pre":
            pre -= 1
            if page.text and "".join(page.text).strip():
                page.line("".join(page.text).rstrip())
            page.text = []
            page.gap = max(page.gap, 1)
        elif tag in ("td", "th") and tables:
            page.flush()
            lines = _trimmed(page.lines)
            page = pages.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag in BLOCKS:
            page.flush()
            if tag == "table":
                page.block(_aligned(tables.pop()))
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                page.indent = indents.pop()
                page.bullet = ""
            page.gap = max(page.gap, 1 if tag in PARAGRAPHS and not (lists and tag in ("ul", "ol", "dl")) else 0)
    page.flush()
    return "\n".join(page.lines).strip("\n").replace("\xa0", " ")


def extract(page: str | None) -> str | None:
    return None if page is None else render(parse(page))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` (page_id, html) to page_id, text."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in rows], dtype=object)

    return pages.select("page_id", run(html_col).alias("text"))


def op3(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
