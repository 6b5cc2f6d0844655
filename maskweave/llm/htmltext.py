"""Main text of web pages by boosted trees over DOM nodes (operator 8).

A page is parsed into block nodes (runs of text beside blocks are nodes of their own). Each node
has features: its tag, the words of its class, id and role, those of its ancestors, depth, subtree
text, link and tag density, punctuation, and statistics of its siblings. Gradient-boosted trees,
trained here in numpy on pages made from random layouts whose parts are known, give the probability
that a node holds main text. Decoding is a dynamic program over the tree under one constraint, that
no node is kept below a dropped one, so ancestors and descendants never contradict each other.

Text is returned whole: character references decoded, white space within a block as one space,
blocks joined by one space in page order.

Defined cases: a null or empty page gives an empty text; unclosed tags end as HTML ends them, a
page that breaks off is read to its end; null ids and repeated rows are kept.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import util

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)?", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"\S+")
_SPACES = re.compile(r"\s+")
#: Elements whose content is not text of the page.
_RAW = frozenset("script style textarea title noscript iframe xmp template svg math object select button option canvas audio video".split())
#: Those of them that hold all up to their end tag, or the page's end; the others, left open, are passed over alone.
_TO_THE_END = frozenset("script style textarea title iframe xmp".split())
#: Those that can't stand in one of their own kind: a second start tag shows that the first was left open.
_FLAT = frozenset("select button option canvas audio video".split())
_BLOCK = frozenset("html body div p article section main nav ul ol li dl dt dd header footer aside form fieldset table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hgroup details summary dialog menu center".split())
_ENDS_P = _BLOCK - {"html", "body"} | {"hr"}
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Words of attributes, as features of what a node is for.
_ASIDE_WORDS = frozenset("nav navigation navbar menu footer header masthead topbar sidebar side aside ad ads advert advertisement adsense sponsor sponsored promo banner cookie cookies consent notice alert warning popup modal comment comments reply replies disqus respond share sharing social related recommended widget login signin signup subscribe subscription newsletter breadcrumb breadcrumbs pagination pager copyright legal search form tags meta byline".split())
_MAIN_WORDS = frozenset("article content post entry story main body text page hentry blog read single".split())
_TAGS = {"article": 0, "main": 0, "p": 1, "blockquote": 1, "pre": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "dl": 4, "menu": 4, "div": 5, "section": 5, "nav": 6, "header": 7, "footer": 8, "aside": 9, "form": 10, "fieldset": 10, "table": 11, "tbody": 11, "tr": 11, "td": 11, "th": 11, "#text": 12, "body": 13, "html": 13}
N_FEATURES = 29


class Node:
    __slots__ = ("tag", "words", "kids", "parent", "text", "links", "tags", "label", "main")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent, self.kids = tag, words, parent, []
        self.text: list[str] = []
        self.links, self.tags, self.label, self.main = 0, 0, 0.0, False
        if parent is not None:
            parent.kids.append(self)


def parse(page: str) -> Node:
    """The tree of block nodes; text stands in nodes without children only."""
    root = Node("html", (), None)
    node = root
    link = 0
    open_raw = ""
    at, n = 0, len(page)

    def say(s: str) -> None:
        nonlocal node
        if s.strip() or node.text:
            node.text.append(s)
            if link:
                node.links += len(s)

    def up(to: Node) -> None:
        nonlocal node
        node = to

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in _RAW and not closing:
            if m.group(3).rstrip().endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if name in _FLAT and end and re.compile(rf"<{name}(?=[\s/>])", re.I).search(page, at, end.start()):
                continue
            at = end.end() if end else n if name in _TO_THE_END else at
            continue
        if name == "a":
            link = 0 if closing else 1
        if name not in _BLOCK:
            node.tags += 1
            if name in ("br", "hr", "img"):
                say(" ")
            continue
        if closing:
            x = node
            while x is not None and x.tag != name:
                x = x.parent
            if x is not None and x.parent is not None:
                up(x.parent)
            continue
        if name in ("html", "body") and (name == "html" or any(k.tag == "body" for k in root.kids)):
            continue
        if name in _ENDS_P:
            x = node
            while x is not None and x.tag != "p":
                if x.tag in ("td", "th", "table", "blockquote", "article", "section", "div", "li", "body"):
                    x = None
                    break
                x = x.parent
            if x is not None:
                up(x.parent)
        if name in _ALIKE:
            x = node
            while x is not None and x.tag not in _WALLS[name]:
                if x.tag in _ALIKE[name]:
                    up(x.parent)
                    if name != "tr" or x.tag == "tr":
                        break
                x = x.parent
        words = tuple(p.lower() for a in _ATTRIBUTE.findall(m.group(3)) for p in _PARTS.findall("".join(a))) if "=" in m.group(3) else ()
        _settle(node)
        node = Node(name, words, node)
        link = 0
    return _finish(root)


def _settle(node: Node) -> None:
    """Text that stands before a child block becomes a node of its own."""
    if node.text:
        own = Node("#text", (), node)
        own.text, own.links, own.tags = node.text, node.links, node.tags
        node.text, node.links, node.tags = [], 0, 0


def _finish(root: Node) -> Node:
    stack = [root]
    while stack:
        x = stack.pop()
        if x.kids:
            _settle(x)
            stack.extend(x.kids)
    return root


def block_text(node: Node) -> str:
    return _SPACES.sub(" ", html.unescape("".join(node.text))).strip()


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.kids))
    return out


def features(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """The nodes in page order, their features, and the index of each one's parent."""
    nodes = in_order(root)
    number = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    parent = np.array([number[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    chars, links, tags, stops, leaves, depth = (np.zeros(n) for _ in range(6))
    own = np.zeros((n, 4))  # words aside, words main, under aside, under main
    kind = np.array([_TAGS.get(x.tag, 5) for x in nodes])
    for i, x in enumerate(nodes):
        if x.text:
            s = "".join(x.text)
            chars[i], links[i] = len(s), x.links
            stops[i] = s.count(".") + s.count(",") + s.count("!") + s.count("?")
            leaves[i] = 1
        tags[i] = x.tags + 1
        own[i, 0] = sum(w in _ASIDE_WORDS for w in x.words)
        own[i, 1] = sum(w in _MAIN_WORDS for w in x.words)
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            own[i, 2] = max(own[p, 2], own[p, 0] > own[p, 1], kind[p] in (6, 7, 8, 9, 10))
            own[i, 3] = max(own[p, 3], own[p, 1] > own[p, 0], kind[p] == 0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        stops[p] += stops[i]
        leaves[p] += leaves[i]
    log = np.log1p(chars)
    f = np.zeros((n, N_FEATURES), np.float32)
    f[np.arange(n), kind] = 1
    f[:, 14:18] = own
    f[:, 18] = depth
    f[:, 19] = log
    f[:, 20] = links / np.maximum(chars, 1)
    f[:, 21] = 100 * tags / np.maximum(chars, 1)
    f[:, 22] = 100 * stops / np.maximum(chars, 1)
    f[:, 23] = np.log1p(leaves)
    f[:, 24] = chars / max(chars[0], 1)
    for x in nodes:
        k = [number[id(y)] for y in x.kids]
        if k:
            mean = log[k].mean()
            f[k, 25] = mean
            f[k, 26] = len(k)
            f[k, 27] = np.arange(len(k)) / len(k)
            f[k, 28] = chars[k].max() / max(chars[number[id(x)]], 1)
    return nodes, f, parent


class Trees:
    """Gradient-boosted regression trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.base)
        size = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            at = np.ones(len(y), np.int64)
            for node in range(1, size):
                rows = np.flatnonzero(at == node)
                best, choice = 1e-6, None
                gs, hs = g[rows].sum(), h[rows].sum()
                if len(rows) >= 40:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, choice = gain[k], (j, k)
                if choice is None:
                    at[rows] = 2 * node
                    continue
                feature[node], cut[node] = choice[0], edges[choice[0]][choice[1]]
                at[rows] = 2 * node + (code[rows, choice[0]] > choice[1])
            leaf = at - size
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
            self.trees.append((feature, cut, value))
            total += value[leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (x[rows, feature[at]] > cut[at])
            total += value[at - len(cut)]
        return total


def decode(logit: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labels with none kept below a dropped one."""
    keep = -np.logaddexp(0, -logit)
    drop = -np.logaddexp(0, logit)
    for i in range(len(logit) - 1, 0, -1):
        p = parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = keep >= drop
    for i in range(1, len(logit)):
        kept[i] &= kept[parent[i]]
    return kept


def made_page(rng: np.random.Generator) -> Node:
    """A page of a random layout; main marks the text of the article."""
    root = Node("html", (), None)
    body = Node("body", (), root)

    def words(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi + 1))
        out = ["".join(rng.choice(list("abcdefghinorstu"), int(rng.integers(2, 9)))) + ("." if rng.random() < 0.12 else "," if rng.random() < 0.06 else "") for _ in range(n)]
        return " ".join(out)

    def put(parent: Node, tag: str, cls: str, text: str = "", link: bool = False, main: bool = False) -> Node:
        x = Node(tag, tuple(p.lower() for p in _PARTS.findall(cls)), parent)
        if text:
            x.text, x.links, x.tags = [text], len(text) if link else 0, int(link) + int(rng.random() < 0.3)
        x.main = main
        return x

    def some(p: float) -> bool:
        return bool(rng.random() < p)

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def plain(cls: str) -> str:
        return cls if some(0.8) else pick("", "x", "box", "row", "wrap")

    def menu(parent: Node) -> None:
        x = put(parent, *((pick("nav", "nav", "div"), pick("nav", "menu", "navbar")) if some(0.5) else ("nav", "")))
        y = put(x, "ul", "") if some(0.8) else x
        for _ in range(int(rng.integers(2, 12))):
            put(y, "li" if y is not x else "div", "", words(1, 3), link=True)

    def aside(parent: Node) -> None:
        x = put(parent, *(("aside", plain("sidebar")) if some(0.6) else ("div", pick("sidebar", "side widget", "related posts"))))
        for _ in range(int(rng.integers(1, 4))):
            if some(0.4):
                put(x, "h3", "", words(1, 4))
            put(x, pick("p", "div"), pick("", "widget"), words(3, 50), link=some(0.5))

    def ad(parent: Node) -> None:
        x = put(parent, "div", pick("ad", "ads", "advert", "sponsored", "promo", "banner ad"), "" if some(0.3) else words(2, 60))
        if not x.text:
            put(x, "p", "", words(2, 40), link=some(0.5))

    def notice(parent: Node) -> None:
        put(parent, "div", pick("notice", "cookie-notice", "alert", "consent banner", "popup"), words(4, 40))

    def form(parent: Node) -> None:
        x = put(parent, "form", pick("", "login", "newsletter", "search"))
        put(x, pick("p", "div", "#text"), "", words(1, 20))

    def comments(parent: Node) -> None:
        x = put(parent, pick("div", "section"), pick("comments", "comment list", "respond", "disqus"))
        if some(0.5):
            put(x, "h3", "", words(1, 3))
        for _ in range(int(rng.integers(1, 6))):
            put(x, pick("p", "div", "article"), pick("", "comment", "comment body", "reply"), words(3, 90))

    def article(parent: Node) -> None:
        how = rng.random()
        x = put(parent, "article", pick("", "post", "story")) if how < 0.6 else put(parent, "main", "") if how < 0.7 else put(parent, "div", pick("content", "article body", "post", "entry content", "story text")) if how < 0.9 else parent
        if some(0.3) and x is not parent:
            x = put(x, pick("div", "section"), pick("", "content", "text", "entry"))
        if some(0.8):
            put(x, pick("h1", "h1", "h2"), "", words(2, 12), main=True)
        if some(0.15):
            put(x, "p", "", words(200, 900), main=True)
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.75:
                put(x, "p", "", words(1, 4) if some(0.15) else words(4, 150), link=some(0.05), main=True)
            elif r < 0.8:
                put(x, pick("h2", "h3"), "", words(1, 8), main=True)
            elif r < 0.86:
                put(x, "blockquote", "", words(5, 60), main=True)
            elif r < 0.92:
                y = put(x, pick("ul", "ol"), "")
                for _ in range(int(rng.integers(2, 6))):
                    put(y, "li", "", words(2, 25), main=True)
            elif r < 0.95:
                put(x, "#text", "", words(3, 80), main=True)
            elif r < 0.97:
                ad(x)
            else:
                put(x, "div", pick("share", "social links", "related"), words(1, 12), link=True)

    outer = put(body, "div", pick("wrap", "page", "container")) if some(0.3) else body
    for part, chance in ((notice, 0.2), (menu, 0.75), (ad, 0.5)):
        if some(chance):
            top = put(outer, "header", pick("", "masthead", "header")) if part is menu and some(0.4) else outer
            if top is not outer:
                put(top, pick("div", "h1", "p"), pick("", "logo"), words(1, 5))
            part(top)
    before = some(0.2)
    if before:
        aside(outer)
    article(outer)
    for part, chance in ((ad, 0.25), (comments, 0.35), (form, 0.25), (notice, 0.1)):
        if some(chance):
            part(outer)
    if not before and some(0.35):
        aside(outer)
    if some(0.85):
        x = put(outer, *(("footer", "") if some(0.75) else ("div", pick("footer", "copyright legal"))), words(2, 25) if some(0.6) else "")
        if not x.text:
            for _ in range(int(rng.integers(1, 6))):
                put(x, pick("p", "div", "li"), "", words(1, 8), link=some(0.6))
    return root


@functools.cache
def model(pages: int = 700, seed: int = 11) -> Trees:
    """Trees of a fixed number of made pages; the same in every process."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, f, parent = features(made_page(rng))
        y = np.array([x.main for x in nodes], float)
        for i in range(len(nodes) - 1, 0, -1):
            y[parent[i]] = max(y[parent[i]], y[i])
        xs.append(f)
        ys.append(y)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    read = [features(parse(p)) if p else None for p in pages]
    some = [r for r in read if r]
    logits = iter(np.split(trees.logit(np.concatenate([f for _, f, _ in some])), np.cumsum([len(f) for _, f, _ in some])[:-1])) if some else iter(())
    out = []
    for r in read:
        if r is None:
            out.append("")
            continue
        nodes, _, parent = r
        kept = decode(next(logits), parent)
        texts = (block_text(x) for x, k in zip(nodes, kept, strict=True) if k and x.text)
        out.append(" ".join(t for t in texts if t))
    return out


def main_text(page: Column, trees: Trees | None = None) -> Column:
    """The main text of a column of pages."""
    trees = trees or model()

    @arrow_udf(util.sql_type("string"))
    def run(column: pa.Array) -> pa.Array:
        parts: list[str] = []
        for at in range(0, len(column), 64):
            parts += extract(column.slice(at, 64).to_pylist(), trees)
        return pa.array(parts, pa.string())

    return run(page)


def extract_pages(pages, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")):
    """keep, text, n_chars: one row for each row of pages."""
    util.ship(pages.sparkSession)
    rows = pages.select(*keep, main_text(F.col(page)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
