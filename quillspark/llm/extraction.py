"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes its blocks of text in order. Every block has a cost of being content and one of being
boilerplate: a logistic model of its text (length, links, punctuation, kind of element) plus what the
elements round it say of themselves. The costs are the capacities to the two terminals; edges between
neighbouring blocks, stronger the closer they lie in the element tree, and between blocks of one
parent, are the price of a border. The maximum flow gives the cheapest labelling.

The model is fitted on blocks whose elements name their role, of at most SAMPLE_PAGES pages (those
with the smallest hashes of page_id); where such blocks are too few, fixed weights stand in.

Defined cases: null and empty pages have an empty text; a page without markup is one block; pages of
any length and depth are read whole in linear time; unclosed and stray tags are taken as a browser
would, roughly; an unclosed comment, script or style hides the rest; repeated rows and rows without
an id are pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field as column_type

#: Pages on which the model is fitted, and the blocks of either kind that it needs.
SAMPLE_PAGES, LEAST_BLOCKS = 1_000, 50
#: Share of the text model in a block's log-odds, and the most that it can say.
TEXT_SHARE, TEXT_LIMIT = 0.5, 3.0
#: Price of a border between neighbours, and between blocks of one parent that others divide.
NEIGHBOUR, SIBLING = 1.0, 0.3
#: Tree steps beyond which blocks are not near each other.
FAR = 8
#: Capacities are integers: log-odds times this.
UNIT = 1000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("noscript template svg math canvas audio video object".split())
#: What elements say of themselves, in log-odds of content.
TAG_HINTS = {"article": 4.0, "main": 4.0, "nav": -5.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "menu": -5.0, "dialog": -5.0, "search": -5.0, "button": -6.0, "select": -6.0, "option": -6.0, "label": -3.0, "fieldset": -4.0, "legend": -3.0}
ROLE_HINTS = {"main": 4.0, "article": 4.0, "navigation": -5.0, "banner": -5.0, "contentinfo": -5.0, "complementary": -5.0, "search": -5.0, "dialog": -5.0, "alertdialog": -5.0, "alert": -5.0, "menu": -5.0, "menubar": -5.0, "form": -5.0, "note": -1.0}
GOOD_WORDS = frozenset("article content story entry post main body text prose".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar "
    "toolbar footer footnav sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus reply replies respond pagination pager search form copyright legal skip toc tags tagcloud".split()
)
_QUOTE = re.compile(r"[>\"']")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG_START = re.compile(r"<(?=[A-Za-z/!?])")


@dataclass
class Block:
    """A run of text between block borders."""

    text: str
    tag: str
    place: int  # element that holds it
    hint: float
    linked: int  # characters in links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # by element number; 0 is the document


def own_hint(tag: str, attributes: str, inside: bool) -> float:
    """What an element says of its text. ``inside``: within an article or main element, whose header
    holds the title."""
    hint = TAG_HINTS.get(tag, 0.0)
    if tag == "header" and not inside:
        hint = -5.0
    if not attributes or tag in ("html", "body"):
        return hint
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(w.lower() for w in _TOKEN.findall(value))
        elif name == "role":
            hint += ROLE_HINTS.get(value.strip().lower(), 0.0)
        elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hint -= 6.0
    if words & BAD_WORDS:
        return hint - 5.0
    if "header" in words and not inside:
        return hint - 4.0
    return hint + (1.5 if words & GOOD_WORDS else 0.0)


class _Reader:
    """One pass over a page. Every search moves forward or is known to fail for good."""

    def __init__(self, source: str):
        self.s, self.page = source, Page()
        self.stack: list[tuple[str, int, float, bool, int]] = [("", 0, 0.0, False, 0)]  # tag, element, hint, inside, links
        self.open: Counter[str] = Counter()
        self.parts: list[tuple[str, bool]] = []
        self.hidden = 0
        self.missing: set[str] = set()

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.s.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """The > that ends the tag, past quoted values; -1 if there is none."""
        while m := _QUOTE.search(self.s, at):
            i = m.start()
            if self.s[i] == ">":
                return i
            close = self._find(self.s[i], i + 1) if self.s[at:i].rstrip().endswith("=") or self.s[i - 1] == "=" else -1
            at = close + 1 if close >= 0 else i + 1
        return -1

    def _flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            tag, place, hint, _, _ = self.stack[-1]
            for entry in reversed(self.stack[-FAR:]):  # the innermost block element names it
                if entry[0] in BLOCK_TAGS:
                    tag, place = entry[0], entry[1]
                    break
            self.page.blocks.append(Block(text, tag, place, hint, sum(len(t) for t, linked in self.parts if linked)))
        self.parts = []

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            self.hidden -= tag in HIDDEN_TAGS

    def _close(self, tag: str) -> None:
        if self.open[tag] <= 0:
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        if tag not in BLOCK_TAGS and any(e[0] in BLOCK_TAGS for e in self.stack[at + 1 :][-FAR:]):
            return  # an inline end inside a block that began later
        if tag in BLOCK_TAGS or any(e[2] != self.stack[at - 1][2] for e in self.stack[at:][-FAR:]):
            self._flush()
        self._pop_to(at)

    def _imply_ends(self, tag: str) -> None:
        """Elements that end where another begins."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for depth in range(len(self.stack) - 1, max(0, len(self.stack) - 64), -1):
            name = self.stack[depth][0]
            if name == "p" or name in ends:
                self._pop_to(depth)
                if tag != "tr" or name == "tr":
                    return self._imply_ends(tag) if name == "p" and ends else None
            elif name in BLOCK_TAGS:
                return None
        return None

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                self._flush()
            elif tag in ("br", "wbr", "img", "input", "embed"):
                self.parts.append((" " if tag != "wbr" else "", False))
            return
        if tag in BLOCK_TAGS:
            self._flush()
            self._imply_ends(tag)
        _, parent, outer, inside, links = self.stack[-1]
        own = own_hint(tag, attributes, inside)
        self.page.parents.append(parent)
        number = len(self.page.parents) - 1
        if own < 0 and tag not in BLOCK_TAGS:
            self._flush()  # inline elements that are no content are blocks
        self.stack.append((tag, number, own + outer / 2 if own else outer, inside or tag in ("article", "main"), links + (tag == "a")))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN_TAGS

    def read(self) -> Page:
        s, at, n = self.s, 0, len(self.s)
        while at < n:
            m = _TAG_START.search(s, at)
            i = m.start() if m else n
            if i > at and not self.hidden:
                text = s[at:i]
                self.parts.append((html.unescape(text) if "&" in text else text, self.stack[-1][4] > 0))
            if i >= n:
                break
            if s.startswith("<!--", i):
                at = self._find("-->", i + 4) + 3
                if at < 3:
                    break
            elif s[i + 1] in "!?":
                at = self._find(">", i) + 1
                if at < 1:
                    break
            else:
                closing = s[i + 1] == "/"
                name = _NAME.match(s, i + 1 + closing)
                end = self._tag_end(name.end() if name else i + 2)
                if end < 0:
                    break
                at = end + 1
                if not name:
                    continue
                tag = name.group().lower()
                if closing:
                    self._close(tag)
                    continue
                self._start(tag, s[name.end() : end])
                if tag in RAW_TAGS:
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(s, at)
                    if not found:
                        break
                    at = found.start()
                    self._pop_to(len(self.stack) - 1)
                    at = self._tag_end(found.end()) + 1
                    if at < 1:
                        break
        self._flush()
        return self.page


def read_page(source: str) -> Page:
    return _Reader(source).read()


# ---- costs --------------------------------------------------------------------------------------

FEATURES = ("words", "links", "sentence", "marks", "heading", "item")
#: Weights that stand in where the pages name no roles, by FEATURES; then the intercept.
PLAIN_WEIGHTS = ((1.3, -4.0, 1.0, 2.0, 1.0, -0.8), -2.0)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The text features of a page's blocks, in order."""
    one = []
    for b in blocks:
        size = len(b.text)
        marks = sum(map(b.text.count, ".,;:!?")) / size
        one.append((math.log1p(b.text.count(" ") + 1), min(1.0, b.linked / size), float(b.text[-1] in ".!?…:;\"'»”"), min(0.2, marks) * 5, float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "td", "th", "dd", "dt", "option"))))
    return one


def log_odds(blocks: list[Block], weights: tuple[tuple[float, ...], float]) -> list[float]:
    """Log-odds of content: the text model, within its limit, and the elements' hints."""
    w, bias = weights
    text = (sum(a * b for a, b in zip(w, x)) + bias for x in features(blocks))
    return [TEXT_SHARE * max(-TEXT_LIMIT, min(TEXT_LIMIT, t)) + b.hint for t, b in zip(text, blocks)]


def nearness(parents: list[int], a: int, b: int) -> float:
    """1 for one element, less for each tree step between two, 0 if they are far apart."""
    steps = 0
    while a != b and steps <= FAR:
        if a > b:  # children have larger numbers
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return 1.0 / (1 + steps) if a == b else 0.0


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges between neighbours, and between blocks of one parent that are no neighbours."""
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        if i:
            near = nearness(page.parents, page.blocks[i - 1].place, b.place)
            edges.append((i - 1, i, round(UNIT * NEIGHBOUR * near)))
        parent = page.parents[b.place]
        if parent >= 0 and last.get(parent, i) < i - 1:
            edges.append((last[parent], i, round(UNIT * SIBLING)))
        last[parent] = i
    return [e for e in edges if e[2]]


# ---- flow ---------------------------------------------------------------------------------------


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling (True: source side) with the smallest cost.

    ``gain`` is a node's capacity from the source less that to the sink. A node whose terminal
    outweighs all its edges is labelled at once and its edges become terminal capacities of its
    neighbours; the maximum flow runs on what is left. Of equal cuts the one with the fewest
    nodes on the source side."""
    gain, n = list(gain), len(gain)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for u, v, c in edges:
        near[u].append((v, c))
        near[v].append((u, c))
    weight = [sum(c for _, c in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if label[v] is not None or (abs(gain[v]) <= weight[v] and not (weight[v] == 0 or gain[v] == -weight[v])):
            continue
        label[v] = gain[v] > 0
        for u, c in near[v]:
            if label[u] is None:
                gain[u] += c if label[v] else -c
                weight[u] -= c
                todo.append(u)
    left = [v for v in range(n) if label[v] is None]
    if left:
        number = {v: i for i, v in enumerate(left)}
        reached = max_flow([gain[v] for v in left], [(number[u], number[v], c) for u, v, c in edges if u in number and v in number])
        for v, i in number.items():
            label[v] = reached[i]
    return [bool(x) for x in label]


def max_flow(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes the source still reaches when the flow is at its maximum (level graphs, blocking flows)."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(there)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for v, g in enumerate(gain):
        if g:
            join(s, v, g, 0) if g > 0 else join(v, t, -g, 0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nth, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                cut = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
            elif nth[u] < len(out[u]):
                e = out[u][nth[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    nth[u] += 1
            elif path:
                u = to[path.pop() ^ 1]
                nth[u] += 1
            else:
                break


def main_text(source: str | None, weights: tuple[tuple[float, ...], float] = PLAIN_WEIGHTS) -> str:
    """The page's content blocks in order, one a line."""
    page = read_page(source or "")
    if not page.blocks:
        return ""
    odds = log_odds(page.blocks, weights)
    keep = min_cut([round(UNIT * z) for z in odds], smoothness(page))
    return "\n".join(b.text for b, k in zip(page.blocks, keep) if k)


# ---- jobs ---------------------------------------------------------------------------------------


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> tuple[tuple[float, ...], float]:
    """Weights of the text features and intercept, from the blocks of ``sample`` pages whose elements
    name their role; both kinds weigh the same."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    few = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", "html").join(F.broadcast(few), "page_id", "left_semi").select("html")  # at most ``sample`` ids

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for source in pdf["html"]:
                known = read_page(source or "").blocks
                found += [(list(x), float(b.hint > 0)) for x, b in zip(features(known), known) if abs(b.hint) >= 2]
            yield pd.DataFrame(found, columns=["x", "label"])

    known = rows.mapInPandas(blocks, "x array<double>, label double").persist()
    try:
        sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
        if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < LEAST_BLOCKS:
            return PLAIN_WEIGHTS
        weight = F.when(F.col("label") == 1, 1.0 / sizes[1.0]).otherwise(1.0 / sizes[0.0]) * (sum(sizes.values()) / 2)
        model = LogisticRegression(regParam=0.01, maxIter=30, weightCol="weight").fit(known.select(array_to_vector("x").alias("features"), "label", weight.alias("weight")))
        return tuple(float(v) for v in model.coefficients), float(model.intercept)
    finally:
        known.unpersist()


def extract(pages: DataFrame, weights: tuple[tuple[float, ...], float] | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    weights = fit(pages) if weights is None else weights

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [main_text(source, weights) for source in pdf.pop("html")]
            yield pdf

    rows = pages.select("page_id", "url", "html")
    return rows.mapInPandas(work, f"page_id {column_type(pages, 'page_id', 'bigint')}, url {column_type(pages, 'url', 'string')}, text string")
