"""Main-text extraction from HTML by tree scoring.

A page is parsed into a tree of block elements that tolerates unclosed and
mis-nested tags. Every run of text in a paragraph-like element earns points for its
length and its commas; the points go to the parent, and in smaller parts to the
ancestors above; each container's sum is discounted by its link density. The best
container is kept, widened to the enclosing ``article`` or ``main`` if there is one,
together with siblings that score well or read like prose. Elements that cannot be
article text (navigation, forms, scripts ...) are left out wherever they stand.

Defined results: a null or empty page, and one without text, gives ''; unclosed
comments and raw-text elements end at the end of the page; equally scored containers:
the first in page order; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import tidy

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr nobr".split())
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg math canvas object audio video applet fieldset input map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPES = frozenset("html body table td th caption button object template".split())
#: Start tag -> open elements that it ends, looked for up to the given barrier.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: Words in class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar"
    " comment comments disqus replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related recommended popup modal overlay"
    " widget pagination pager toolbar search skip hidden complementary contentinfo".split()
)
NEGATES = frozenset("has no with without not is".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


class Node:
    """A block element: its name, its children (Nodes and text runs) and what scoring needs. ``inside``: it stands in an article or main element."""

    __slots__ = ("children", "dropped", "inside", "links", "main", "name", "order", "parent", "points", "size")

    def __init__(self, name: str, parent: Node | None, dropped: bool, main: bool, order: int) -> None:
        self.name, self.parent, self.dropped, self.main, self.order = name, parent, dropped, main, order
        self.inside = parent is not None and (parent.main or parent.inside)
        self.children: list = []
        self.points, self.size, self.links = 0.0, 0, 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _is_boilerplate(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").split():
            parts = re.split(r"[^a-z0-9]+", token)
            if parts[0] not in NEGATES and not BOILERPLATE.isdisjoint(parts):
                return True
    return False


class _Open:
    """The open elements from the root down, with the depths at which each name stands, so that nothing climbs the tree."""

    def __init__(self, root: Node) -> None:
        self.stack, self.depths, self.scopes = [root], {}, []

    @property
    def node(self) -> Node:
        return self.stack[-1]

    def push(self, x: Node) -> None:
        self.depths.setdefault(x.name, []).append(len(self.stack))
        if x.name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(x)

    def last(self, names) -> int:
        """The depth of the innermost open element with one of the names; 0 without one."""
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def ended(self, names: list[str], barrier: int, outer: bool) -> int:
        """The depth of the innermost (or outermost) open element with one of the names beyond the barrier; 0 without one."""
        lists = [d for n in names if (d := self.depths.get(n)) and d[-1] > barrier]
        if outer:
            return min((d[bisect_right(d, barrier)] for d in lists), default=0)
        return max((d[-1] for d in lists), default=0)

    def paragraph(self) -> int:
        """The depth of an open ``p`` with no scope inside of it; 0 without one."""
        at = self.last(("p",))
        return at if at and (not self.scopes or self.scopes[-1] < at) else 0

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(self.stack) > depth:
            x = self.stack.pop()
            self.depths[x.name].pop()
            if x.name in SCOPES:
                self.scopes.pop()


def parse(html: str) -> Node:
    """The tree of block elements; of the inline ones only links are told apart."""
    root = Node("html", None, False, False, 0)
    opened, made, at, link = _Open(root), 1, 0, False

    def text(raw: str) -> None:
        if raw:
            opened.node.children.append((unescape(raw) if "&" in raw else raw, link))

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m[1] or m[3]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name, raw = name.lower(), m[2] or m[4] or ""
        if m[0][1] == "/":
            if name in INLINE:
                link = link and name != "a"
            elif name == "br" or name == "p" and not opened.paragraph():
                opened.node.children.append(("\n", False))
            elif depth := opened.paragraph() if name == "p" else opened.last((name,)):
                opened.close(depth)
                link = False
            continue
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = end.start() if end else len(html)
            continue
        if name in INLINE:
            link = link or name == "a"
            continue
        if name in VOID:
            if name in ("br", "hr"):
                opened.node.children.append(("\n", False))
            continue
        if name in ("html", "body"):
            continue
        ended = opened.paragraph() if name in CLOSES_P else 0
        if name in ENDS:
            names, barrier = ENDS[name]
            ended = opened.ended(names.split(), opened.last(barrier), name == "tr")
        if ended:
            opened.close(ended)
            link = False
        attributes = _attributes(raw)
        main = name in ("article", "main") or attributes.get("role") == "main" or "articlebody" in attributes.get("itemprop", "")
        dropped = name in DROPPED or not main and _is_boilerplate(attributes)
        if not raw.endswith("/") or name not in ("svg", "path"):
            child = Node(name, opened.node, dropped, main, made)
            made += 1
            opened.node.children.append(child)
            opened.push(child)
    text(html[at:])
    return root


def _walk(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    return out


def _settle(nodes: list[Node]) -> None:
    """Drop page headers outside the article, and keep what holds an article or a main element."""
    holds = set()
    for x in nodes:
        if x.main:
            p = x.parent
            while p is not None and p not in holds:
                holds.add(p)
                p = p.parent
    for x in nodes:
        if x.name == "header":
            heading = any(isinstance(c, Node) and c.name in HEADINGS for c in x.children)
            x.dropped = x.dropped or not x.inside or not heading
        if x in holds and x.name not in DROPPED:
            x.dropped = False


def _score(root: Node) -> list[Node]:
    """Give points; the kept nodes in page order."""
    kept, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.dropped:
            kept.append(x)
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    for x in kept:
        own = [c for c in x.children if not isinstance(c, Node)]
        words = " ".join("".join(t for t, _ in own).split())
        x.size, links = len(words), sum(len(t.strip()) for t, a in own if a)
        x.links, size = links, x.size
        if size:
            points = (1 + words.count(",") + min(size / 100, 3.0)) * (0.25 if x.name in HEADINGS else 1.0) * (1 - min(1.0, links / size))
            p, part = (x.parent if x.name in PARAGRAPHS and x.parent else x), 1.0
            while p is not None and part > 0.05:
                p.points += points * part
                p, part = p.parent, part / 2 if part == 1.0 else part / 1.5
    for x in reversed(kept[1:]):  # children before their parents
        x.parent.size += x.size
        x.parent.links += x.links
    return kept


def _density(x: Node) -> float:
    return min(1.0, x.links / x.size) if x.size else 0.0


def _append_text(x: Node, out: list[str]) -> None:
    """Text of a subtree without dropped elements; a block's edges count as white space."""
    todo: list = [x]
    while todo:
        y = todo.pop()
        if isinstance(y, str):
            out.append(y)
        elif isinstance(y, tuple):
            out.append(y[0])
        elif not y.dropped:
            out.append(" ")
            todo.append(" ")
            todo += reversed(y.children)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    _settle(_walk(root))
    kept = _score(root)
    best = max(kept, key=lambda x: (x.points * (1 - _density(x)), -x.order))
    if best.size == 0:
        return ""
    x = best
    while x is not None:
        if x.main:
            best = x
        x = x.parent
    parts: list[Node] = [best]
    if best.parent is not None:
        limit = max(10.0, 0.2 * best.points * (1 - _density(best)))
        parts = []
        for s in best.parent.children:
            if isinstance(s, Node) and not s.dropped:
                good = s.points * (1 - _density(s)) >= limit
                prose = s.name in PARAGRAPHS and s.size > 0 and (s.name in HEADINGS or (_density(s) < 0.25 and s.size > 80) or (_density(s) == 0 and s.size > 0 and not best.main))
                if s is best or good or prose:
                    parts.append(s)
    out: list[str] = []
    for x in parts:
        _append_text(x, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns ``keep``, text and n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", *keep, "text", "n_chars"])

    schema = T.StructType([rows.schema["id"], *(rows.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
