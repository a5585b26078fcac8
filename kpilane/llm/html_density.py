"""Main text of web pages by composite text density.

The page is cut into tags and text and built into a tree of its block elements
(inline tags only count). For every node with C characters of text, T tags, LC
characters and LT tags inside links, the composite density is

    C / T * log(C * T / (LC * LT), base = ln(C / (C - LC) * LC + LC_body / C_body * C + e))

with counts below 1 taken as 1 where they divide: text per tag, the less the more
of it is links. A node's density sum adds the densities of its children. The
subtree with the largest density sum is the core of the page; the smallest
density on the path from it up to body is the threshold; every subtree off that path
whose density reaches the threshold is kept too, and so is all of an
article or main element that encloses the core. Menus, headers, footers,
sidebars, notices, adverts, form fields, scripts and styles are taken
out before, by their element or role. Forms, and elements whose class or id names such a part or reader comments (a listed
word as a whole token, or one of ``TELLING`` as part of one: ``comment-list``, ``siteFooter``) go too, unless
they enclose the main text: they hold the page's largest article or main element, or its only h1 or one in an
article, or, where the page has none of these elsewhere, most of its text. By another listed word
that is part of a token (``post-header``) an element goes where it
neither encloses the core nor holds an h1 and its text is less than ``SPARSE`` times as
dense as the core's (characters outside links per block, a mean weighted by characters); inline ones stay.

Blocks are joined in page order by an empty line; white space inside a block is
one space. Linear in the page; each page is a row of its own, so there is no
shuffle.

Defined results: a null or empty page, or one without text, gives "" and 0;
tags left open end with their parent, stray end tags are skipped; repeated rows
are extracted each on their own.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import slices, texts_of

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements of HTML by their part in a page: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr nobr".split())
DROPPED = frozenset(
    "nav footer aside button select option optgroup fieldset input dialog menu svg canvas audio video object "
    "applet map head".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar "
                          "toolbar alertdialog advertisement".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices "
    "alert banner cookie cookies consent gdpr popup modal overlay ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promoted promotion comment comments commentlist disqus reply replies respondform form "
    "search share sharing social related recommended newsletter subscribe subscription signup login toolbar widget "
    "widgets pagination pager skip hidden".split())
# words that name their part also inside a longer name
TELLING = frozenset("comment comments commentlist disqus reply replies footer sidebar notice notices cookie cookies consent "
                    "gdpr".split())
# a new element of the left kind ends an open one of the right kinds, up to the named barriers: fixed values
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SPARSE = 2 / 3
BODY_CHILD_HEADER = frozenset(["body", "html", "#root"])

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total",
                 "own_tags", "own_link_tags", "suspect")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list = []  # text and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = self.own_tags = self.own_link_tags = 0
        self.density = self.total = 0.0
        self.suspect = 0  # how a listed word is in its class or id: SUSPECT or TOLD


def _is_boilerplate(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and parent.tag in BODY_CHILD_HEADER:
        return True  # a page header; an article's own header holds its title
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in DROPPED_ROLES:
                return True
        elif name == "hidden":
            return True
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
    return False


SUSPECT, TOLD = 1, 2


def _suspicion(tag: str, attributes: str) -> int:
    """TOLD where the class or id names a part that goes, SUSPECT where a listed word is part of a name, else 0."""
    if tag == "form":
        return TOLD
    if "=" not in attributes or tag in ("body", "html", "article", "main"):
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            value = value.strip("\"'")
            parts = _NAME_WORD.findall(_CAMEL.sub(" ", value).lower())
            if not DROPPED_WORDS.isdisjoint(value.lower().split()) or not TELLING.isdisjoint(parts):
                return TOLD
            if not DROPPED_WORDS.isdisjoint(parts):
                found = SUSPECT
    return found


def parse(page: str) -> Node:
    """The tree of a page's block elements with its text; dropped elements keep no text."""
    root = node = Node("#root", None, False)
    stack: list[tuple[str, Node]] = []  # open elements, inline ones too: (tag, the node around them)
    links = 0
    at, size = 0, len(page)
    search = _TAG.search
    while at < size:
        found = search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text and not node.dropped:
            node.parts.append((text, links > 0))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # an end tag
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    depth = -1  # does not reach out of its block
                    break
            else:
                depth = -1
            if depth >= 0:
                for name, _ in stack[depth:]:
                    links -= name == "a"
                node = stack[depth][1]
                del stack[depth:]
            continue
        if tag in VOID:
            node.parts.append(("", False) if node.dropped or tag in ("wbr", "img") else (" ", False))
            node.own_tags += 1
            continue
        if tag not in INLINE:
            closes, barriers = CLOSES.get(tag, (frozenset(["p"]), frozenset(["td", "th", "button", "object"])))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closes:
                    for name, _ in stack[depth:]:
                        links -= name == "a"
                    node = stack[depth][1]
                    del stack[depth:]
                    break
                if stack[depth][0] in barriers or (closes == {"p"} and stack[depth][0] not in INLINE):
                    break
        attributes = found[3] or ""
        dropped = node.dropped or _is_boilerplate(tag, attributes, node)
        suspicion = 0 if dropped else _suspicion(tag, attributes)
        if tag in INLINE and suspicion != TOLD and not (dropped and not node.dropped):
            stack.append((tag, node))
            node.own_tags += 1
            if tag == "a":
                links += 1
                node.own_link_tags += 1
        elif not attributes.endswith("/") or tag in RAW:
            child = Node(tag, node, dropped)
            child.suspect = suspicion
            node.parts.append(child)
            stack.append((tag, node))
            node = child
        if tag in RAW:  # its content is not markup
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.start() if end else size
    return root


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums; all kept nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.chars, node.link_chars, node.tags, node.link_tags = 0, 0, node.own_tags, node.own_link_tags
        order.append(node)
        stack += [c for c in node.parts if isinstance(c, Node) and not c.dropped]
    order.reverse()
    for node in order:
        for part in node.parts:
            if isinstance(part, Node):
                if not part.dropped:
                    node.chars += part.chars
                    node.tags += part.tags + 1
                    node.link_chars += part.link_chars
                    node.link_tags += part.link_tags
            else:
                length = len(part[0].strip()) if part[0].isspace() or len(part[0]) < 64 else len(part[0])
                node.chars += length
                if part[1]:
                    node.link_chars += length
    body = root
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt = node.link_chars, max(node.link_tags, 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(base) if base > 1.0 + 1e-9 \
                else c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0))
    for node in order:
        node.total = sum(c.density for c in node.parts if isinstance(c, Node) and not c.dropped) \
            or node.density  # a leaf stands for itself
    return order


def _core(order: list[Node]) -> tuple[Node, list[Node]]:
    """The subtree with the largest density sum, and the path from it up."""
    core = max(reversed(order), key=lambda n: n.total)  # of equal sums, the outermost
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return core, path


def _drop_told(root: Node) -> None:
    """Drop the elements that their names tell to be no main text, from the outermost in, but not what encloses it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.parts if isinstance(c, Node) and not c.dropped]
    # of every subtree: text outside links, the text of its largest article or main, its number of h1
    size, largest, titles = ({id(n): 0 for n in order} for _ in range(3))
    for node in reversed(order):
        key = id(node)
        size[key] += sum(len(" ".join(x[0].split())) for x in node.parts if not isinstance(x, Node) and not x[1])
        if node.tag in ("article", "main"):
            largest[key] = max(largest[key], size[key], 1)
        titles[key] += node.tag == "h1"
        if node.parent is not None:
            above = id(node.parent)
            size[above] += size[key]
            largest[above] = max(largest[above], largest[key])
            titles[above] += titles[key]
    whole, most, all_titles = size[id(root)], largest[id(root)], titles[id(root)]

    def encloses(node: Node) -> bool:
        key, up = id(node), node.parent
        if largest[key]:
            return largest[key] == most
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if titles[key]:
            return up is not None or not most and titles[key] == all_titles
        return up is None and not most and not all_titles and 5 * size[key] > 4 * whole

    stack = [root]
    while stack:
        node = stack.pop()
        for child in node.parts:
            if isinstance(child, Node) and not child.dropped:
                if child.suspect == TOLD and not encloses(child):
                    child.dropped = True
                else:
                    stack.append(child)


def _drop_suspects(order: list[Node], core: Node, path: list[Node]) -> None:
    """Drop the elements that a part of a name and their density both speak against."""
    around = {id(n) for n in path}
    titled: set[int] = set()
    sums: dict[int, list[int]] = {id(n): [0, 0] for n in order}  # of the text lengths of the blocks, and of their squares
    for node in order:  # children before parents
        own = sum(len(" ".join(x[0].split())) for x in node.parts if not isinstance(x, Node) and not x[1])
        mine = sums[id(node)]
        mine[0] += own
        mine[1] += own * own
        if node.parent is not None:
            above = sums[id(node.parent)]
            above[0] += mine[0]
            above[1] += mine[1]
            if node.tag == "h1" or id(node) in titled:
                titled.add(id(node.parent))

    def usual(node: Node) -> float:
        total, squares = sums[id(node)]
        return squares / max(total, 1)

    for node in order:
        if node.suspect == SUSPECT and id(node) not in around and id(node) not in titled and node.tag != "h1" \
                and usual(node) < SPARSE * usual(core):
            node.dropped = True


def _select(root: Node) -> list[Node]:
    """The subtrees to keep, in page order."""
    _drop_told(root)
    order = _measure(root)
    core, path = _core(order)
    if any(n.suspect == SUSPECT for n in order):
        _drop_suspects(order, core, path)
        order = _measure(root)
        core, path = _core(order)
    threshold = min(n.density for n in path)
    for node in reversed(path):
        if node.tag in ("article", "main"):
            core = node
            break
    inside = {id(n) for n in path[path.index(core):]}
    kept: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node is core:
            kept.append(node)
        elif id(node) in inside:
            stack += [c for c in reversed(node.parts) if isinstance(c, Node) and not c.dropped]
        elif node.density >= threshold:
            kept.append(node)
    return kept


def _blocks(root: Node, out: list[str]) -> None:
    """The text of a subtree, a piece for each run of text between block boundaries."""
    piece: list[str] = []

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                out.append(text)
            piece.clear()

    stack: list = [iter(root.parts)]
    while stack:
        for part in stack[-1]:
            if not isinstance(part, Node):
                piece.append(part[0])
            elif not part.dropped:
                flush()
                stack.append(iter(part.parts))
                break
            elif part.tag not in RAW:
                flush()
        else:
            flush()
            stack.pop()


def extract(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    for node in _select(parse(page)):
        _blocks(node, out)
    return "\n\n".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(p) for p in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
            .mapInArrow(run, SCHEMA))
