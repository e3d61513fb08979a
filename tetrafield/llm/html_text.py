"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant scanner builds the tree of block elements and text blocks. Each node is described by the size, density and
link share of its subtree, the words in its attributes, its depth, its ancestors and its siblings; boosted trees give the
probability that it holds main text. Decoding picks the likeliest labelling of the whole page in which nothing below a
node without main text is main text. The trees are trained here, on pages that a seeded generator writes with known
answers (TRAIN_PAGES of them, from made-up words); no page of the corpus is needed.

Cases: null or empty html gives an empty text; text without any markup is one block; broken markup (unclosed or
misnested tags, cut-off references) is read as far as it goes; whole pages are read, whatever their length; repeated rows
get the same result; an empty table gives an empty result; clashing input columns (text, n_chars) are replaced.
"""

from __future__ import annotations

import functools
import html as markup
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

TRAIN_PAGES, SEED = 700, 5
TREES, DEPTH, RATE, BINS = 60, 4, 0.25, 32
ADDED = ("text", "n_chars")

# Elements by how they are read, fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HIDDEN = frozenset("head script style template noscript iframe object svg math textarea select button option canvas audio video map title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
KINDS = ("article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "li", "p", "h", "td", "blockquote", "#text")
# Words in class, id and role that tell what a part is for, fixed values.
WORDS = {
    "content": "article content post body entry main story text paragraph prose".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs topbar tabs skip links toc".split(),
    "frame": "header masthead banner footer foot contentinfo copyright legal bottom colophon".split(),
    "side": "sidebar aside side rail widget complementary related recommended popular trending archive tags".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp".split(),
    "notice": "cookie cookies consent notice alert warning gdpr popup modal overlay dialog message announcement subscribe newsletter paywall signup".split(),
    "comment": "comment comments commentary reply replies respond discussion disqus thread feedback reviews responses".split(),
    "form": "form search login signin register input contact".split(),
    "share": "share sharing social follow byline author meta pagination pager rating".split(),
}
_GROUP = {w: i for i, ws in enumerate(WORDS.values()) for w in ws}
_TOKENS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*+))")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
RAW = frozenset("script style textarea title noscript iframe template".split())  # read to their own end tag
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Node:
    __slots__ = ("name", "parent", "own", "children", "text", "link", "groups", "depth", "last", "paragraphs", "items", "texts", "commas", "hidden")

    def __init__(self, name: str, parent: int, groups: int, depth: int):
        self.name, self.parent, self.groups, self.depth = name, parent, groups, depth
        self.own, self.children, self.text, self.link = "", [], 0, 0
        self.paragraphs = self.items = self.texts = self.commas = 0


@functools.lru_cache(4096)
def _groups_of(attributes: str) -> int:
    """Bits of WORDS named by class, id or role."""
    bits = 0
    for _, value in _ATTRIBUTE.findall(attributes):
        for token in _TOKENS.findall(value):
            bits |= 1 << _GROUP[token.lower()] if token.lower() in _GROUP else 0
    return bits


def _tags(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match of _OPEN) of tags in order; the match is None for comments, declarations and raw elements with their content.

    A quote that hides a tag's end up to the page's is no quote, and none after it is.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while m := _OPEN.search(page, at):
        start = m.start()
        if m["name"] is None:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0])
            end = page.find(mark or ">", m.end())
            if end < 0 and mark is None:
                return  # a declaration without an end is text, as is what follows: no tag ends there either
            at = len(page) if end < 0 else end + len(mark or ">")
            yield start, at, None
            continue
        if last < m.end():
            at = m.end()
            continue
        closed = _QUOTED.match(page, m.end()) if quotes else None
        if closed is None:
            quotes = False
        at = closed.end() if closed else page.find(">", m.end()) + 1
        name = m["name"].lower()
        if name not in RAW or m["end"]:
            yield start, at, m
            continue
        over = _RAW_END[name].search(page, at)
        end = page.find(">", over.end()) if over else -1
        at = len(page) if end < 0 else end + 1
        yield start, at, None


def parse(page: str) -> list[Node]:
    """Block elements and text blocks in page order, parents first; the first is the root. Time is in proportion to the page."""
    nodes = [Node("#root", -1, 0, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; the node of the block they are in
    places: dict[str, list[int]] = {}  # where in the stack each name is open
    hidden = links = 0
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(markup.unescape("".join(run)).split())
            if text:
                parent = stack[-1][1]
                node = Node("#text", parent, 0, nodes[parent].depth + 1)
                node.own, node.text, node.link = text, len(text), min(linked, len(text))
                node.texts, node.commas = 1, text.count(",") + text.count(".")
                nodes[parent].children.append(len(nodes))
                nodes.append(node)
            run.clear()
        linked = 0

    def close(to: int) -> None:
        """Closes open elements down to stack position `to`."""
        nonlocal hidden, links
        if any(name in BLOCKS for name, _ in stack[to:]):
            flush()
        for name, _ in stack[to:]:
            hidden -= name in HIDDEN
            links -= name == "a"
            places[name].pop()
        del stack[to:]

    def innermost(names: tuple, bounds: tuple = ()) -> int:
        """The place of the last open element of these names, 0 if none is open within the bounds."""
        last = lambda ns: max((places[n][-1] for n in ns if places.get(n)), default=0)
        return at if (at := last(names)) > last(bounds) else 0

    at = 0
    for start, end, m in _tags(page):
        if start > at and not hidden:
            piece = page[at:start]
            run.append(piece)
            linked += len(piece) if links else 0
        at = end
        if m is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in VOID:
                run.append(" ") if name == "br" and not hidden else None
            elif i := innermost((name,)):
                close(i)
            continue
        if name in VOID:
            if not hidden:
                run.append(" ")
            continue
        if name in CLOSES_P and (i := innermost(("p",), ("td", "th", "li", "table", "button", "object"))):
            close(i)
        if name in SAME and (i := innermost(SAME[name], BOUNDS[name])):
            close(i)
        attributes = page[m.end() : end - 1]
        if name in BLOCKS and not hidden:
            flush()
            parent = stack[-1][1]
            nodes[parent].children.append(len(nodes))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, len(nodes)))
            nodes.append(Node(name, parent, _groups_of(attributes), nodes[parent].depth + 1))
        elif not attributes.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append((name, stack[-1][1]))
            hidden += name in HIDDEN
            links += name == "a"
    if at < len(page) and not hidden:
        run.append(page[at:])
        linked += len(page) - at if links else 0
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        node, above = nodes[i], nodes[nodes[i].parent]
        above.text += node.text
        above.link += node.link
        above.texts += node.texts
        above.commas += node.commas
        above.paragraphs += node.paragraphs + (node.name == "p")
        above.items += node.items + (node.name == "li")
    return nodes


def _kind(name: str) -> int:
    if name in ("ol", "menu", "dl"):
        name = "ul"
    elif name in ("dd", "dt", "tr", "th"):
        name = "td" if name in ("tr", "th") else "li"
    elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
        name = "h"
    return KINDS.index(name) if name in KINDS else len(KINDS)


_KIND = {n: _kind(n) for n in [*BLOCKS, "#text", "#root"]}
N_GROUPS = len(WORDS)
OUTER = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table")
_OUTER = {n: 1 << i for i, n in enumerate(OUTER)}


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each node."""
    whole = max(nodes[0].text, 1)
    before, inherited, outside = 0, [0] * len(nodes), [0] * len(nodes)
    rank, started = [0] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        started[i] = before
        if node.name == "#text":
            before += node.text
        if i:
            p = node.parent
            inherited[i] = inherited[p] | nodes[p].groups
            outside[i] = outside[p] | _OUTER.get(nodes[p].name, 0)
        for k, c in enumerate(node.children):
            rank[c] = k
    rows = []
    for i, node in enumerate(nodes):
        above = nodes[max(node.parent, 0)]
        kin, k = above.children, rank[i]
        prior = nodes[kin[k - 1]] if i and k else None
        after = nodes[kin[k + 1]] if i and k + 1 < len(kin) else None
        size = max(node.text, 1)
        groups, own = node.groups, node.own
        rows.append((
            node.depth, k, len(kin), len(node.children), math.log1p(node.text), node.text / whole, node.link / size, node.texts, size / max(node.texts, 1),
            node.paragraphs, node.items, node.commas / size * 100, started[i] / whole, (started[i] + node.text) / whole, node.text / max(above.text, 1),
            above.link / max(above.text, 1), above.paragraphs, above.items, math.log1p(above.text),
            math.log1p(prior.text) if prior else -1, prior.link / max(prior.text, 1) if prior else -1, math.log1p(after.text) if after else -1, after.link / max(after.text, 1) if after else -1,
            _KIND[node.name], _KIND[above.name], _KIND[prior.name] if prior else -1, _KIND[after.name] if after else -1,
            own.count(" ") + 1 if own else 0, ("©" in own) + ("|" in own) + ("»" in own), own[-1:] in ".!?", own[:1].isupper(), groups, inherited[i], outside[i],
        ))
    flat = np.array(rows, np.float32)
    bits = [((flat[:, c].astype(np.int64)[:, None] >> np.arange(n)) & 1) for c, n in ((-3, N_GROUPS), (-2, N_GROUPS), (-1, len(OUTER)))]
    kinds = flat[:, 23].astype(np.int64)[:, None] == np.arange(len(KINDS))
    return np.hstack([flat[:, :-3], *bits, kinds]).astype(np.float32)


class Boosted:
    """Gradient-boosted trees of a fixed depth for the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        n, width = bins.shape
        self.depth, self.start = depth, math.log((y * weight).sum() / ((1 - y) * weight).sum())
        self.feature, self.cut = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf, np.float32)
        self.leaf = np.zeros((trees, 2**depth))
        flat = bins + np.arange(width) * BINS
        raw = np.full(n, self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = (y - p) * weight, p * (1 - p) * weight
            place = np.zeros(n, np.int64)  # within the level
            for d in range(depth):
                cells = (place[:, None] * (width * BINS) + flat).ravel()
                size = 2**d * width * BINS
                gs = np.bincount(cells, np.repeat(g, width), size).reshape(2**d, width, BINS).cumsum(2)
                hs = np.bincount(cells, np.repeat(h, width), size).reshape(2**d, width, BINS).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                best = gain.reshape(2**d, -1).argmax(1)
                for leaf, b in enumerate(best.tolist()):
                    f, cut = divmod(b, BINS)
                    if gain[leaf, f, cut] > 1e-6 and cut < len(self.edges[f]):
                        self.feature[t, 2**d - 1 + leaf], self.cut[t, 2**d - 1 + leaf] = f, self.edges[f][cut]
                at = 2**d - 1 + place
                place = 2 * place + (x[np.arange(n), self.feature[t, at]] >= self.cut[t, at])
            self.leaf[t] = rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + 1)
            raw += self.leaf[t, place]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def decode(nodes: list[Node], odds: list[float]) -> list[str]:
    """Text blocks of the likeliest consistent labelling: a node out takes all below it out; the root is in."""
    n = len(nodes)
    # relative to "everything out": what a node gains by being in, with the best choice below it
    gain = list(odds)
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    inside = [False] * n
    inside[0] = True
    blocks = []
    for i in range(1, n):
        inside[i] = inside[nodes[i].parent] and gain[i] > 0
        if inside[i] and nodes[i].name == "#text":
            blocks.append(nodes[i].own)
    return blocks


def extract(model: Boosted, pages: list[str | None]) -> list[str]:
    trees = [parse(p) if isinstance(p, str) and p else None for p in pages]
    found = [t for t in trees if t and len(t) > 1]
    if not found:
        return [""] * len(pages)
    odds = iter(np.split(model.log_odds(np.vstack([features(t) for t in found])), np.cumsum([len(t) for t in found])[:-1]))
    out = []
    for t in trees:
        if not t or len(t) == 1:
            out.append("")
        elif (own := next(odds)) is not None and all(x.name in ("#text", "#root") for x in t):
            out.append("\n\n".join(x.own for x in t[1:]))  # nothing but text
        else:
            out.append("\n\n".join(decode(t, own.tolist())))
    return out


def main_text(spark: SparkSession, pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, without html, with text and n_chars (its code points)."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            pages, out, group, size = part.tolist(), [], [], 0
            for p in pages:
                group.append(p)
                size += len(p) if isinstance(p, str) else 0
                if size > 1 << 20:
                    out += extract(shared.value, group)
                    group, size = [], 0
            yield pd.Series(out + (extract(shared.value, group) if group else []), dtype="object")

    kept = [c for c in pages.columns if c not in (*ADDED, html_col)]
    return pages.select(*kept, run(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@functools.lru_cache(1)
def trained() -> Boosted:
    from .html_pages import page

    rng = np.random.default_rng(SEED)
    xs, ys, ws = [], [], []
    for _ in range(TRAIN_PAGES):
        nodes = parse(page(rng))
        main = [n.own.startswith("①") for n in nodes]  # the generator marks main text by this sign
        for n in nodes:
            if n.own[:1] in "①②":
                n.own = n.own[1:]
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] |= main[i]
        xs.append(features(nodes))
        ys.append(main)
        ws.append([2.0 if n.name == "#text" else 1.0 for n in nodes])
    return Boosted(np.vstack(xs), np.concatenate(ys).astype(float), np.concatenate(ws))
