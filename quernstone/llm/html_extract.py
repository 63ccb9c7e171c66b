"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware text renderer.

All visible text comes out: blocks on lines of their own, a blank line around
paragraphs, headings, lists and tables, list items marked and indented, table
cells padded into columns, preformatted text as it is. Formulas, labels of
drawings and the options that a select shows are text too. Style rules count if
they hold on a screen of SCREEN pixels.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

# The element groups of the HTML standard that this builder uses.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta title style script template noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist source track param area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer main nav address form li dt dd tr caption center details summary dialog dir figcaption hgroup legend menu option optgroup tbody thead tfoot search".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag closes an open element of its value, unless one of the given elements stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Lines this far in aren't moved further, else the text of a page could grow with the square of its depth.
FAR, QUOTED = " " * 2000, "> " * 1000
SCOPE = frozenset("table td th caption html body template".split())
#: What svg elements define or describe, but don't draw.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: Start tags that end svg and math, as the standard lists them.
BREAKOUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Width and height of the screen that media conditions are tested on, and other features that are known of it.
SCREEN = {"width": 1280.0, "height": 800.0}
MEDIA = {"orientation:landscape": True, "orientation:portrait": False, "hover": True, "hover:hover": True, "hover:none": False, "pointer:fine": True, "pointer:coarse": False, "prefers-color-scheme:light": True, "prefers-color-scheme:dark": False}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote opens a value only after an equals sign; nothing is ever given back, so the scan is linear.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CSS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|url\([^)]*\)|[{};]", re.S | re.I)
_DECLARED = re.compile(r"(display|visibility)\s*:\s*([\w-]+)[^!]*(!\s*important)?", re.I)
_SIZE = r"([\d.]+)(px|em|rem)?"
_BOUND = re.compile(rf"(min-|max-)?(?:device-)?(width|height):{_SIZE}")
_RANGE = re.compile(rf"(?:{_SIZE}([<>]=?))?(width|height)(?:([<>]=?|=){_SIZE})?")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


def parse(html: str) -> Node:
    """The element tree."""
    return _parse(html)[0]


def _parse(html: str) -> tuple[Node, int]:
    """The element tree, of any depth, and its depth. html, head and body are implied; unknown end tags are ignored."""
    root = Node("html")
    depth = 1
    stack, opened = [root], defaultdict(list)  # opened: places of the elements on the stack by tag, so that none is searched for

    def open_(tag: str, attrs: dict | None = None) -> None:
        node = Node(tag, attrs or {})
        stack[-1].children.append(node)
        push(node)

    def push(node: Node) -> None:
        nonlocal depth
        stack.append(node)
        depth = max(depth, len(stack))
        opened[node.tag].append(len(stack) - 1)

    def last(tags) -> int:
        return max((opened[x][-1] for x in tags if x in opened and opened[x]), default=0)

    def close(tags, stop) -> bool:
        at = last(tags)
        if not at or last(stop) > at:
            return False
        while len(stack) > at:
            opened[stack.pop().tag].pop()
        return True

    def foreign() -> bool:
        return last(("svg", "math")) > last(("foreignobject", "annotation-xml"))

    def text(s: str) -> None:
        if not s:
            return
        if len(stack) == 1 or stack[-1].tag == "head":
            if not s.strip():
                return
            body()
        stack[-1].children.append(s)

    def body() -> None:
        close({"head"}, ())
        if len(stack) == 1:
            if (known := next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), None)) is not None:
                push(known)
            else:
                open_("body")

    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            text(unescape(html[at:]))
            break
        text(unescape(html[at:mark]))
        m = _NAME.match(html, mark)
        if m is None:
            if html.startswith("<!--", mark):
                at = html.find("-->", mark + 4) + 3
            elif html.startswith(("<!", "<?"), mark):
                at = html.find(">", mark) + 1
            else:
                text("<")
                at = mark + 1
            if at <= mark:  # what is left open takes the rest
                break
            continue
        end = _REST.match(html, m.end()).end()
        if end == n:  # as browsers do: a tag that never ends shows nothing
            break
        tag, said, at = m[2].lower(), html[m.end() : end], end + 1
        if m[1]:
            if tag == "p" and not opened["p"]:
                body()
                open_("p")
            if tag == "br":
                body()
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else {"table"} - {tag})
            continue
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(said)} if said and not said.isspace() else {}
        if tag in ("html", "body"):
            if tag == "body":
                body()
            (root if tag == "html" else stack[1]).attrs.update(attrs)
            continue
        if tag == "head":
            if len(stack) == 1:
                open_(tag, attrs)
            continue
        if len(stack) == 1 or stack[-1].tag == "head":
            if tag not in HEAD:
                body()
            elif len(stack) == 1 and not root.children:
                open_("head")
        if tag in BREAKOUT:
            while foreign():
                close({"svg", "math"}, ())
        if tag in IMPLIED:
            closes, stop = IMPLIED[tag]
            while close(closes, stop):
                pass
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr")
        elif tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in VOID or said.endswith("/") and (tag in ("svg", "path", "math") or foreign()):
            stack[-1].children.append(Node(tag, attrs))
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            inner = html[at : end.start() if end else n]
            at = html.find(">", end.end()) + 1 or n if end else n
            stack[-1].children.append(Node(tag, attrs, [unescape(inner) if tag in ("textarea", "title") else inner]))
        else:
            open_(tag, attrs)
    return root, depth


def _feature(term: str) -> bool | None:
    """Whether one term of a media query holds on screen; None if that isn't known."""
    if not term.startswith("("):
        return term in ("all", "screen")
    term = re.sub(r"\s+", "", term)[1:-1]
    pixels = lambda x, unit: float(x) * (16 if unit in ("em", "rem") else 1) if re.fullmatch(r"\d*\.?\d+|\d+\.", x) else float("nan")
    if m := _BOUND.fullmatch(term):
        have, want = SCREEN[m[2]], pixels(m[3], m[4])
        return have >= want if m[1] == "min-" else have <= want if m[1] == "max-" else have == want
    if m := _RANGE.fullmatch(term):
        test = lambda x, sign, y: x == y and "=" in sign or x < y and "<" in sign or x > y and ">" in sign
        have = SCREEN[m[4]]
        return (m[3] is None or test(pixels(m[1], m[2]), m[3], have)) and (m[5] is None or test(have, m[5], pixels(m[6], m[7])))
    return MEDIA.get(term)


def on_screen(query: str) -> bool:
    """Whether a media query list surely holds on screen."""
    query = query.strip().lower()
    for one in query.split(","):
        one = one.strip()
        turned = re.match(r"not\b", one) is not None
        ways = [[_feature(t.strip()) for t in re.split(r"\band\b", way)] for way in re.split(r"\bor\b", re.sub(r"^(?:not|only)\b", "", one))]
        if turned and not any(None in way for way in ways) and not any(all(way) for way in ways) or not turned and any(all(way) for way in ways):
            return True
    return not query


def _style_rules(css: str) -> list[tuple[str, list[str]]]:
    """(selectors, declarations) of the rules that hold on screen. Rules nested in others are left out, conditions nested in them are not."""
    css = re.sub(r"/\*.*?(?:\*/|$)", "", css, flags=re.S)
    out, start = [], 0
    frames: list[tuple[str | None, bool, list]] = [(None, True, [])]  # selectors (None: a group of rules), whether it holds, declarations
    for m in _CSS.finditer(css + "}" * (css.count("{") + 1)):  # what is left open ends here
        if m[0] not in ("{", "}", ";"):
            continue
        part, start = css[start : m.start()].strip(), m.end()
        names, holds, said = frames[-1]
        if m[0] == "{":
            if at := re.match(r"@([\w-]+)(.*)", part, re.S):
                kind, condition = at[1].lower(), at[2]
                holds = holds and (on_screen(condition) if kind == "media" else kind == "layer" or kind == "supports" and not re.match(r"\s*not\b", condition, re.I))
                frames.append((names, holds, []))
            else:
                frames.append((part, holds, []) if names is None else ("", False, []))
            continue
        if names and part:
            said.append(part)
        if m[0] == "}" and len(frames) > 1:
            frames.pop()
            if names and holds and said:
                out.append((names, said))
    return out


class Sheet:
    """Simple selectors (tag, .class, #id, tag.class, tag#id) by which style elements hide on screen, or show what others hide."""

    def __init__(self, root: Node):
        self.keys: dict[tuple[str, str], dict[str, tuple]] = {}  # by property: important, specificity, order, whether it hides
        todo, order = [root], 0
        while todo:
            node = todo.pop()
            if node.tag == "style" and on_screen(node.attrs.get("media", "")):
                for names, said in _style_rules("".join(node.children)):
                    found = [m for x in said if (m := _DECLARED.match(x))]
                    for one in names.split(",") if found else ():
                        if (m := _SIMPLE.fullmatch(one.strip())) and one.strip():
                            key = (m[1].lower() if m[1] else "", m[2] or "")
                            rank = (key[1].startswith("#"), key[1].startswith("."), key[0] != "")
                            for d in found:
                                order += 1
                                name = d[1].lower()
                                gone = d[2].lower() in (("none",) if name == "display" else ("hidden", "collapse"))
                                mine = self.keys.setdefault(key, {})
                                mine[name] = max(mine.get(name, ()), (d[3] is not None, rank, order, gone))
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if not any(x[3] for of in self.keys.values() for x in of.values()):
            self.keys = {}

    def says(self, node: Node) -> dict[str, tuple]:
        """By property, what the rules say of the node: whether it is important, its rank, and whether it hides."""
        if not self.keys:
            return {}
        names = ["", *("." + c for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "")]
        of = [self.keys[t, x] for t in ("", node.tag) for x in names if (t or x) and (t, x) in self.keys]
        return {p: max(x[p] for x in of if p in x) for p in {p for x in of for p in x}}


def _styled(node: Node, sheet: Sheet) -> dict[str, bool]:
    """Whether the node's display, and its visibility, hide it, as far as its style or the rules say."""
    rules = sheet.says(node)
    out = {p: x[3] for p, x in rules.items()}
    if "style" in node.attrs:
        for one in node.attrs["style"].split(";"):
            if (m := _DECLARED.match(one.strip())) and (m[3] or not rules.get(name := m[1].lower(), (False,))[0]):
                out[m[1].lower()] = m[2].lower() in (("none",) if m[1].lower() == "display" else ("hidden", "collapse"))
    return out


def _prune(root: Node, sheet: Sheet) -> None:
    """Takes out all that isn't shown: elements without display, with all in them, and the text of invisible ones, whose elements may be visible again."""
    todo = [(root, True)]
    while todo:
        node, seen = todo.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    kept.append(child)
                continue
            if child.tag in HIDDEN or "hidden" in child.attrs or child.tag == "dialog" and "open" not in child.attrs:
                continue
            style = _styled(child, sheet) if child.attrs or sheet.keys else {}
            if style.get("display"):
                continue
            mine = not style["visibility"] if "visibility" in style else seen
            if child.tag == "input" and not mine:
                continue
            kept.append(child)
            todo.append((child, mine))
        node.children = kept


class Flow:
    """Lines under way: collapses spaces within a line and blank lines between blocks."""

    def __init__(self):
        self.lines, self.run, self.gap, self.wide = [], [], 0, False

    def text(self, s: str) -> None:
        if self.wide:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.run.append(first)
            for x in rest:
                self.end(0, True)
                self.run.append(x)
            return
        self.run.append(_SPACE.sub(" ", s))

    def end(self, gap: int, force: bool = False) -> None:
        """Ends the line; ``gap`` blank lines at least before the next."""
        line = "".join(self.run)
        line = line.rstrip() if self.wide else re.sub(" +", " ", line).strip(" ")
        self.run = []
        if line or force:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines.append(line)
            self.gap = 0
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str], gap: int) -> None:
        self.end(gap)
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines += lines
            self.gap = gap


def _lines(node: Node, wide: bool = False) -> list[str]:
    flow = Flow()
    flow.wide = wide
    _walk(node, flow)
    flow.end(0)
    while flow.lines and not flow.lines[-1]:
        flow.lines.pop()
    while flow.lines and not flow.lines[0]:
        flow.lines.pop(0)
    return flow.lines


def _opened(node: Node, gap: int | None = None) -> list:
    """What the walk holds of an element: itself, its children to come, whether it is a closed details, its next number, and its blank lines."""
    closed = node.tag == "details" and "open" not in node.attrs
    number = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    return [node, iter(node.children), closed, number, gap]


def _walk(node: Node, flow: Flow) -> None:
    """Lays out what is in ``node``. Only lists' items, tables and quotes, which get lines of their own, recurse."""
    frames = [_opened(node)]
    while frames:
        frame = frames[-1]
        node, children, closed, _, gap = frame
        for child in children:
            if isinstance(child, str):
                if not closed:
                    flow.text(child)
                continue
            tag = child.tag
            if closed and tag != "summary":
                continue
            if tag == "br":
                flow.end(0, True)
            elif tag == "hr":
                flow.end(1)
            elif tag == "input":
                if child.attrs.get("type", "").lower() in ("button", "submit", "reset") and child.attrs.get("value"):
                    flow.text(f" {child.attrs['value']} ")
            elif tag == "select":
                flow.text(f" {' '.join(_options(child))} ")
            elif tag == "svg":
                _drawing(child, flow)
            elif tag == "math":
                _formula(child, flow)
            elif tag == "table":
                flow.block(_table(child), 1)
            elif tag == "li":
                mark = f"{frame[3]}. " if node.tag == "ol" else "- "
                frame[3] += 1
                inner = _lines(child)
                flow.block([(mark if i == 0 else " " * len(mark) if x and not x.startswith(FAR) else "") + x for i, x in enumerate(inner)], 0)
            elif tag == "dd":
                flow.block(["  " + x if x and not x.startswith(FAR) else x for x in _lines(child)], 0)
            elif tag in ("blockquote", "pre", "textarea"):
                inner = _lines(child, tag != "blockquote" or flow.wide)
                flow.block(["> " + x if tag == "blockquote" and not x.startswith(QUOTED) else x for x in inner], 1)
            elif tag in BLOCK:
                space = 1 if tag in SPACED and not (tag in ("ul", "ol", "dl") and node.tag == "li") else 0
                flow.end(space)
                frames.append(_opened(child, space))
                break
            else:
                if tag in ("td", "th"):
                    flow.text(" ")
                frames.append(_opened(child))
                break
        else:
            frames.pop()
            if gap is not None:
                flow.end(gap)


def _said(node: Node) -> str:
    """The text of a node that lays out nothing, spaces collapsed."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x.children)
    return _SPACE.sub(" ", "".join(out)).strip()


def _options(node: Node) -> list[str]:
    """The options that a select shows: all of a list box, else the last selected or the first enabled one."""
    every, todo = [], [(c, False) for c in reversed(node.children)]
    box = "multiple" in node.attrs or re.fullmatch(r"\s*0*([2-9]|[1-9]\d+)\s*", node.attrs.get("size", "")) is not None
    while todo:
        x, off = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag == "option":
            every.append((x.attrs.get("label") or _said(x), "selected" in x.attrs, off or "disabled" in x.attrs))
            continue
        if x.tag == "optgroup" and box and x.attrs.get("label"):
            every.append((x.attrs["label"], False, True))
        todo += [(c, off or x.tag == "optgroup" and "disabled" in x.attrs) for c in reversed(x.children)]
    if box:
        return [t for t, _, _ in every]
    return ([t for t, chosen, _ in every if chosen][-1:] or [t for t, _, off in every if not off][:1])


def _drawing(node: Node, flow: Flow) -> None:
    """The text elements of an svg, apart from one another, and the pages within it."""
    todo = [(c, False) for c in reversed(node.children)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str):
            if shown:
                flow.text(x)
        elif x.tag == "foreignobject":
            flow.end(0)
            _walk(x, flow)
            flow.end(0)
        elif x.tag not in UNDRAWN and x.attrs.get("display") != "none" and x.attrs.get("visibility") not in ("hidden", "collapse"):
            if x.tag == "text" or x.tag == "tspan" and not x.attrs.keys().isdisjoint(("x", "y", "dy")):
                flow.text(" ")
                todo.append((" ", True))
            todo += [(c, shown or x.tag == "text") for c in reversed(x.children)]


def _formula(node: Node, flow: Flow) -> None:
    """The tokens of a formula; a fraction's parts are set apart by a slash, cells by spaces."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            flow.text(x)
        elif x.tag not in ("annotation", "annotation-xml"):
            inner = [c for c in x.children if isinstance(c, Node) or c.strip()]
            if x.tag in ("mfrac", "mtr", "mtable"):
                inner = [y for c in inner for y in ("/" if x.tag == "mfrac" else " ", c)][1:]
            todo += reversed(inner)


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def _table(node: Node) -> list[str]:
    """Rows of cells padded to their column's width; a cell of several lines takes several lines of its row, one of several rows leaves its place in the later ones empty."""
    caption, rows, todo = [], [], [node]
    under: list[list[int]] = []  # [place, columns, rows to come] of cells of several rows
    while todo:
        part = todo.pop(0)
        under = []  # such cells end with their group of rows
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    caption.append(_SPACE.sub(" ", child).strip())
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo.insert(0, child) if child.tag == "thead" else todo.append(child)
            elif child.tag == "tr":
                cells, at, wait = [], 0, sorted(under)
                for c in [*child.children, None]:
                    if isinstance(c, str) and not c.strip():
                        continue
                    while wait and (c is None or wait[0][0] <= at):
                        if wait[0][0] > at:  # columns that this row leaves out
                            cells.append((at, [], wait[0][0] - at))
                        cells.append((wait[0][0], [], wait[0][1]))
                        at = max(at, wait[0][0] + wait[0][1])
                        wait.pop(0)
                    if c is None:
                        break
                    if isinstance(c, str):
                        cells.append((at, [_SPACE.sub(" ", c).strip()], 1))
                        at += 1
                        continue
                    span, down = (int(x) if re.fullmatch(r"[1-9]\d{0,4}", x := c.attrs.get(k, "1")) else 1 for k in ("colspan", "rowspan"))
                    span = min(span, 1000)  # the standard's limit
                    cells.append((at, _lines(c), span))
                    if down > 1:
                        under.append([at, span, down])
                    at += span
                for x in under:
                    x[2] -= 1
                under = [x for x in under if x[2] > 0]
                rows.append(cells)
            elif child.tag not in ("col", "colgroup"):
                caption += _lines(Node("div", {}, [child]) if child.tag in ("select", "svg", "math") else child)
    widths: dict[int, int] = {}
    for cells in rows:
        for at, lines, span in cells:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *map(_width, lines)])
    known = sorted(widths)
    sums = [0, *accumulate(widths[x] for x in known)]
    out = list(caption)
    for cells in rows:
        wide = [sums[bisect_left(known, at + span)] - sums[bisect_left(known, at)] + 3 * (span - 1) for at, _, span in cells]
        for k in range(max((len(x) for _, x, _ in cells), default=0)):
            line = []
            for (_, lines, _), w in zip(cells, wide, strict=True):
                s = lines[k] if k < len(lines) else ""
                line.append(s + " " * max(0, w - _width(s)))
            out.append(" | ".join(line).rstrip())
    return out


def extract(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not html:
        return ""
    root, depth = _parse(html.replace("\x00", "�"))
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 3 * depth + 1000))  # Python's own frames, which don't use the C stack
    try:
        _prune(root, Sheet(root))
        return "\n".join(_lines(root))
    finally:
        sys.setrecursionlimit(before)


def extract_pages(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` and text (string) of every row, repeated rows one by one. Null and empty pages give an empty text.

    A page that is not HTML comes out as its text; unclosed and stray tags are
    mended as browsers do, at any depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(x.as_py()) for x in part.column(html_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(lean(run), f"{schema}, text string")
