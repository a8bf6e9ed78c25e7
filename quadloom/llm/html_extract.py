"""The main text of web pages, by scoring the tree.

Paragraphs pass points for their length and their commas to their ancestors; a container's points are discounted by its
link density and, in elements whose class or id names something else than the text, by a factor. The best container is
kept with those siblings that belong to the text, up to the article or main element around it if there is one. Elements
are only left out unscored if they can hold no text, are hidden, or are lists of links.

Every step is one pass over the tree, so time is linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NO_TEXT = frozenset("head script style noscript template iframe svg math canvas object audio video form button select option textarea input fieldset label nav aside footer menu dialog map title xmp noembed noframes datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p td pre blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element closes an open one of these before it, up to the given bounds.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
BOILERPLATE = frozenset(
    "ad ads adbox advert advertisement adverts advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login"
    " menu menubar nav navbar navigation navigate breadcrumb breadcrumbs topbar toolbar pagination pager tabs sitemap skip footer foot masthead header sidebar side aside rail widget widgets related recommended recommendations share sharing social"
    " comment comments commentlist disqus discussion respond reply replies hidden".split()
)
#: Words that make a class name a statement about the page (``no-sidebar``, ``comments-open``).
STATES = frozenset("no not non without with has have is open opened closed enabled disabled on off active".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
WHOLE = frozenset("#root html body main article".split())
BLOCKS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Points in an element of a boilerplate name count so much outside it, and it counts so much against others.
DOUBT = 0.1


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "doubted", "dropped", "length", "linked", "held", "first", "rest", "factor")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list = []
        self.doubted = self.dropped = False
        self.length = self.linked = 0
        self.held = self.first = self.rest = 0.0  # points in it, of its own paragraphs, and passed up from below
        self.factor = 1.0


class _Tree:
    """The element that is being read, and how many of each name are open around it."""

    def __init__(self):
        self.root = self.here = Node("#root", None)
        self.open: Counter[str] = Counter()

    def add(self, tag: str, attributes: str, enter: bool) -> None:
        node = Node(tag, self.here, attributes)
        self.here.children.append(node)
        if enter:
            self.here = node
            self.open[tag] += 1

    def leave(self, node: Node) -> None:
        """Close everything up to ``node``, and it."""
        while self.here is not node:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent
        self.open[node.tag] -= 1
        self.here = node.parent

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        up = self.here
        while up.tag != tag:
            if tag in INLINE and up.tag not in INLINE:  # an inline end tag does not close the blocks around it
                return
            up = up.parent
        self.leave(up)

    def close(self, tags: frozenset, bounds: frozenset) -> None:
        """Close the outermost open one of ``tags`` within ``bounds``."""
        if not any(self.open[t] for t in tags):
            return
        up, found = self.here, None
        left = sum(self.open[t] for t in tags)
        while left and up.parent is not None and up.tag not in bounds:
            if up.tag in tags:
                found = up
                left -= 1
            up = up.parent
        if found is not None:
            self.leave(found)


def parse(page: str) -> Node:
    """A forgiving tree: elements and strings. Character references are decoded; comments and raw elements are left out."""
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            tree.here.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            tree.here.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[6]
        if not tag or not (m[4] or m[8]):  # a comment, or a tag that the end of the page cuts off
            continue
        tag, attributes = tag.lower(), m[3] or m[7] or ""
        if m[1] or m[5]:
            tree.end(tag)
            continue
        if tag in ("html", "body") and tree.open[tag]:
            continue
        if tag in CLOSES_P:
            tree.close(_P, _P_BOUNDS)
        if tag in SIBLINGS:
            tree.close(*SIBLINGS[tag])
        raw = tag in RAW
        tree.add(tag, attributes, not raw and tag not in VOID and not attributes.rstrip().endswith("/"))
        if raw:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
    return tree.root


_P, _P_BOUNDS = frozenset(("p",)), frozenset(("td", "th", "table", "button", "object"))


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names in a class or id is that of something else than the text."""
    for name in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        if not BOILERPLATE.isdisjoint(words) and STATES.isdisjoint(words):
            return True
    return False


def _judge(node: Node, in_article: bool) -> None:
    """Whether an element is left out, or doubted."""
    if node.tag in NO_TEXT:
        node.dropped = True
        return
    if node.tag == "header" and not in_article:  # a page's header; that of an article holds its title
        node.doubted = True
    if node.attributes:
        for name, a, b, c in _ATTRIBUTE.findall(node.attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                node.doubted |= node.tag not in ("html", "body", "main") and _names_boilerplate(value)
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                node.dropped = True


def _survey(root: Node) -> list[Node]:
    """The elements that are not left out, in page order, judged and measured; lists of links are left out then."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        if node is not root:
            _judge(node, in_article)
        if not node.dropped:
            order.append(node)
            in_article |= node.tag in ("article", "main")
            stack += [(c, in_article) for c in reversed(node.children) if not isinstance(c, str)]
    for node in reversed(order):
        elements = 0
        for c in node.children:
            if isinstance(c, str):
                node.length += len(" ".join(c.split()))
            elif not c.dropped:
                elements += 1
                node.length += c.length
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.length
        # a list of links
        if node.tag in ("ul", "ol", "dl", "table", "div", "p") and elements >= 3 and node.length and node.linked >= 0.8 * node.length:
            node.dropped, node.length, node.linked = True, 0, 0
    return [n for n in order if not n.dropped]


def _own_text(node: Node) -> str:
    """Text of a block and of the inline elements in it, without that of inner blocks."""
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item is node or not item.dropped and (item.tag in INLINE or item.tag == "br"):
            out.append(" " if item.tag == "br" else "")
            stack += reversed(item.children)
    return " ".join("".join(out).split())


def _score(order: list[Node]) -> None:
    """Points from the paragraphs up: whole to the container, half to the next, two thirds of that to each further one."""
    for node in reversed(order):
        if node.tag in PARAGRAPHS and (own := _own_text(node)):
            points = 1 + own.count(",") + min(len(own) / 100, 3)
            node.held += points
            container = node if node.tag in ("div", "section", "article", "main", "body") else node.parent
            container.first += points
        up = node.parent
        if up is not None:
            share = DOUBT if node.doubted else 1.0
            up.held += node.held
            up.rest += share * (node.first / 2 + node.rest / 1.5)
    for node in order:
        if node.parent is not None:
            node.factor = node.parent.factor * (DOUBT if node.doubted else 1.0)


def _worth(node: Node) -> float:
    return (node.first + node.rest) * node.factor * (1 - node.linked / node.length if node.length else 0)


def _text(nodes: list, most: float) -> str:
    """Text of some nodes in page order, without doubted elements in them that hold less than ``most`` points."""
    out, stack = [], [(x, True) for x in reversed(nodes)]
    while stack:
        item, top = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.dropped or item.doubted and not top and item.held < most:
            out.append("" if item.tag in INLINE else " ")
        elif item.tag in INLINE:
            stack += [(c, False) for c in reversed(item.children)]
        else:  # blocks, and line breaks, part words
            out.append(" ")
            stack.append((" ", True))
            stack += [(c, False) for c in reversed(item.children)]
    return " ".join("".join(out).split())


def extract(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and for one without text."""
    if not page:
        return ""
    root = parse(page)
    order = _survey(root)
    _score(order)
    best = max((n for n in order if n.first or n.rest), key=_worth, default=None)
    if best is None:
        return _text(root.children, 0.0)
    most = best.held / 2
    named = best  # the article or main element that the best container lies in
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    least, kept, node = max(5.0, 0.2 * _worth(best)), [best], best
    while node is not named and node.tag not in WHOLE:
        beside = []
        for c in node.parent.children:
            if c is node:
                beside += kept
            elif isinstance(c, str):
                beside += [c] if named is not None else []
            elif not c.dropped and not c.doubted and c.length:
                density = c.linked / c.length
                if _worth(c) >= least or c.tag in BLOCKS and density < 0.25 or named is not None and (c.tag in BLOCKS or density < 0.5):
                    beside.append(c)
        kept, node = beside, node.parent
        if named is None:  # no element names the text: its siblings, and no more
            break
    return _text(kept, most)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: dict[str, Column] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``, and the strings that ``carry`` names and makes.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank. Null
    and empty pages and pages without text give an empty text; cut-off pages are read as far as they go; repeated rows
    and null ids are kept row by row; other columns are ignored. No shuffle; memory is one Arrow batch and one page's
    tree.
    """

    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(page.as_py()) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), *part.columns[3:]], ["page_id", "url", "text", "n_chars", *more])

    more = list(carry or {})
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *(c.alias(n) for n, c in (carry or {}).items()))
    return rows.mapInArrow(run, ", ".join(["page_id long, url string, text string, n_chars long", *(f"{n} string" for n in more)]))
