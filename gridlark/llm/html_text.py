"""HTML extraction: build a tree with implied tags, then lay out its visible text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import carried, slices, texts

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes xmp title textarea".split())
INVISIBLE = set("head script style template noscript iframe noembed noframes title meta link base object audio video canvas datalist".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks with a blank line around them, and those on lines of their own.
SPACED = HEADINGS | set("p ul ol dl table blockquote pre figure hr".split())
BLOCKS = SPACED | set("address article aside body center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav option search section summary tr caption thead tbody tfoot td th".split())
#: What a start tag closes if it is open, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
P_CLOSERS = (SPACED | set("address article aside center details dialog div dd dt fieldset figcaption footer form header li main menu nav search section summary".split())) - {"caption"}
#: Start tags that stay in an open head; any other begins the body.
IN_HEAD = set("title meta link base style script noscript template".split())
#: End tags of other elements do not reach beyond these.
WALLS = {"table", "td", "th", "caption"}
#: Fixed values of HTML: the most columns, and rows, that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BLANKS = re.compile(r"[ \t\n\f\r]+")
VISIBILITY = re.compile(r"(?:^|;)visibility:(hidden|collapse|visible)")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def build_tree(source: str) -> Node:
    """The elements and texts of a page; missing end tags, rows and cells are implied."""
    root = Node("html")
    stack, opened = [root], Counter()

    def pop_to(at: int) -> None:
        while len(stack) > at:
            opened[stack.pop().tag] -= 1

    def close(tags: set[str], walls: set[str]) -> None:
        """Close the outermost of ``tags`` that is open this side of the walls."""
        if not any(opened[t] for t in tags):
            return
        found = 0
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in walls:
                break
            if stack[at].tag in tags:
                found = at
        if found:
            pop_to(found)

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def leave_head() -> None:
        """What cannot stand in a head begins the body, whose start tag may be left out."""
        if stack[-1].tag == "head":
            pop_to(len(stack) - 1)

    def text(t: str) -> None:
        t = html.unescape(t)
        if BLANKS.sub("", t):
            leave_head()
        stack[-1].kids.append(t)

    def start(tag: str, rest: str) -> None:
        if tag in ("html", "body"):
            close({"head"}, set())
            return
        if tag not in IN_HEAD:
            leave_head()
        if tag in P_CLOSERS:
            close({"p"}, WALLS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr"))
        node = Node(tag, _attributes(rest) if rest.strip(" /") else None)
        push(node)
        if tag in VOID:
            pop_to(len(stack) - 1)

    def end(tag: str) -> None:
        if not opened[tag]:
            if tag == "p":  # implies an empty paragraph
                start("p", "")
                pop_to(len(stack) - 1)
            return
        walls = {"table"} if tag in WALLS | {"tr", "thead", "tbody", "tfoot"} else WALLS
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag == tag:
                pop_to(at)
                return
            if stack[at].tag in walls:
                return

    at = 0
    while at < len(source):
        m = TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            end(tag)
            continue
        start(tag, rest)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw = source[at : stop.start() if stop else len(source)]
            stack[-1].kids.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            pop_to(len(stack) - 1)
            at = stop.end() if stop else len(source)
    return root


def hidden(node: Node) -> bool:
    """Whether nothing of an element is displayed, whatever its parts say."""
    if node.tag in INVISIBLE or node.tag == "dialog" and "open" not in node.attrs:
        return True
    if not node.attrs:
        return False
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return "hidden" in node.attrs or "display:none" in style or node.tag == "input"


def visibility(node: Node, inherited: bool) -> bool:
    """Whether the texts of an element are seen; its parts inherit that and may say otherwise."""
    if "style" not in node.attrs:
        return inherited
    said = VISIBILITY.findall(re.sub(r"\s", "", node.attrs["style"].lower()))
    return said[-1] == "visible" if said else inherited


def displayed(node: Node) -> list[Node | str]:
    """The parts of an element that can be seen: of closed details, the first summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [k for k in node.kids if not isinstance(k, str) and k.tag == "summary"][:1]
    return node.kids


class Sheet:
    """Lines of text under way; margins of neighbouring blocks collapse."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now = ""
        self.gap = self.want_space = False
        self.indent = [""]
        self.lead: str | None = None  # how the next line begins, if not by the indent

    def text(self, t: str, keep: bool = False) -> None:
        if keep:
            for k, line in enumerate(t.split("\n")):
                if k:
                    self.flush(force=True)
                self.add(line)
            return
        words = BLANKS.sub(" ", t).replace("\xa0", " ")
        if words.startswith(" "):
            self.want_space = True
        if words.strip(" "):
            self.add((" " if self.want_space and self.now and not self.now.endswith(" ") else "") + words.strip(" "))
            self.want_space = words.endswith(" ")

    def add(self, t: str) -> None:
        if not self.now and t:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now = self.indent[-1] if self.lead is None else self.lead
            self.lead = None
        self.now += t

    def flush(self, force: bool = False) -> None:
        if self.now.strip() or force:
            self.lines.append(self.now.rstrip())
        self.now, self.want_space = "", False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or spaced and bool(self.lines)

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    """A span of rows or columns; 0 is to the end, what is no number 1."""
    text = node.attrs.get(name, "1").strip()
    return min(most, int(text)) if text.isdecimal() and text.isascii() else 1


def _table(rows: list[list[tuple[int, int, list[str]]]], widest: int | None) -> list[str]:
    """Rows of cells with aligned columns; a cell is (columns, rows, lines).

    A cell that reaches down keeps its columns free in the rows below; one over
    several columns is as wide as these. Columns in which no cell begins do not count.
    """
    until: dict[int, int] = {}  # the row from which on a column is free again
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for across, down, lines in row:
            while until.get(at, 0) > r:
                at += 1
            cells.append((at, at + across, lines))
            if down != 1:
                until.update(dict.fromkeys(range(at, at + across), r + down if down else len(rows)))
            at += across
        placed.append(cells)
    begins = sorted({at for cells in placed for at, _, _ in cells})
    placed = [[(bisect_left(begins, at), bisect_left(begins, end), lines) for at, end, lines in cells] for cells in placed]
    widths = [0] * len(begins)
    for at, end, lines in sorted((c for cells in placed for c in cells), key=lambda c: c[1] - c[0]):
        wide = max(map(len, lines), default=0)
        if widest is None or wide <= widest:
            widths[end - 1] += max(0, wide - sum(widths[at:end]) - 3 * (end - at - 1))
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            parts, column = [], 0
            for at, end, lines in cells:
                parts += [" " * w for w in widths[column:at]]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(widths[at:end]) + 3 * (end - at - 1)))
                column = end
            out.append(" | ".join(parts).rstrip())
    return out


def render(root: Node, widest: int | None = None) -> str:
    """All visible text: blank lines between spaced blocks, list marks, aligned cells."""
    sheets, tables, lists = [Sheet()], [], []
    seen, drawn = [True], []  # visibility of the open elements; of open drawings, whether in a text
    pre = 0
    steps: list[tuple[Node | str, bool]] = [(root, False)]
    while steps:  # no recursion: pages nest as deep as they like
        node, leaving = steps.pop()
        sheet = sheets[-1]
        if isinstance(node, str):
            if seen[-1] and (not drawn or drawn[-1]):
                sheet.text(node, keep=pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if tag != "html" and hidden(node):
                continue
            if tag == "br":
                sheet.flush(force=True)
                continue
            seen.append(visibility(node, seen[-1]))
            if tag in ("svg", "foreignobject") or drawn and tag == "text":
                sheet.block(False)  # a text of a drawing stands alone
                drawn.append(tag != "svg")
            if tag in BLOCKS:
                sheet.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                first = node.attrs.get("start", "1")
                lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                if seen[-1]:
                    sheet.lead = (sheet.indent[-1] if sheet.lead is None else sheet.lead) + mark
                sheet.indent.append(sheet.indent[-1] + " " * len(mark))
                kind[1] += 1
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                sheets.append(Sheet())
            steps.append((node, True))
            steps.extend((kid, False) for kid in reversed(displayed(node)))
            continue
        seen.pop()
        if tag in ("svg", "foreignobject") or drawn and tag == "text":
            sheet.block(False)
            drawn.pop()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "pre":
            pre -= 1
        elif tag in ("td", "th") and tables:
            lines = sheets.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((max(1, _span(node, "colspan", MOST_COLUMNS)), _span(node, "rowspan", MOST_ROWS), lines))
            continue
        elif tag == "table":
            for line in _table(tables.pop(), widest):
                sheet.add(line)
                sheet.flush(force=True)
        elif tag == "li":
            sheet.flush()
            sheet.lead = None
            sheet.indent.pop()
        if tag in BLOCKS:
            sheet.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return "\n".join(sheets[0].done()).strip("\n")


def extract_text(pages: DataFrame, source: str = "html", carry: list[str] | None = None, widest: int | None = None) -> DataFrame:
    """The carried columns (default page_id) and text, n_chars, n_lines of each whole page.

    Visible are the texts outside scripts, styles, the head, templates, closed
    dialogs, the bodies of closed details, and elements hidden by attribute or
    style (of what ``visibility`` hides, parts may be visible again); of
    drawings, the texts. Paragraphs, headings, lists and
    tables stand between blank lines, other blocks on lines of their own; list
    items have marks or numbers and are indented by nesting; the cells of a
    table's column are aligned to the widest, over row and column spans. That
    pads a column's other rows to its widest cell, so that a page's text may grow to
    rows times that width; ``widest`` leaves columns with a wider cell unpadded
    by it (default: align all). White space collapses but in ``pre``. A null
    page has a null text with 0 characters; an empty one an empty text; repeated rows give
    repeated results. Pages are read whole, in memory that grows with the page.
    """
    made = ["text", "n_chars", "n_lines"]
    carry = carried(pages, ["page_id"] if carry is None else carry, made)
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry] + ["text string, n_chars long, n_lines long"])
    at = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [None if h is None else render(build_tree(h), widest) for h in batch.column(at).to_pylist()]
            chars = [len(t or "") for t in found]
            lines = [t.count("\n") + 1 if t else 0 for t in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string()), pa.array(chars, pa.int64()), pa.array(lines, pa.int64())], names=[*carry, *made])

    return texts(pages.select(*carry, pages[source].alias("_html"))).mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every whole page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
