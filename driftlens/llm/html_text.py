"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A naive Bayes classifier over a block's features (its tag and the names of its nearest
named element, length, share of link text, last character) is trained on blocks in zones that pages mark themselves; its
log odds, together with the zone's, become terminal capacities. Neighbouring blocks, and neighbours under one parent, are
joined by smoothness edges. The minimum cut separates content from boilerplate.

What elements say of their text adds up below them, unless they wrap the page: html and body do, and what holds a main
element, the largest article, or most of the text of a page that marks no content outside of it. Tags and names such as
nav, footer or comments weigh more than classifier and neighbours together; names such as alert, search or share, which
articles have too, weigh less than these, and less still as a part of a longer name, so that there the cut decides. Main
and article elements speak for their text, where nothing of the first kind is around them.

Null and empty pages have an empty text. Pages are labelled one by one: repeated rows, ties, null ids and extra columns
do not matter; a column of the result's name gives way to it. Very long pages are labelled whole, in time proportional to
their blocks. An empty table gives an empty result. The classifier is trained on about SAMPLE_PAGES pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2000
#: Weights of edges between neighbours and between neighbours under one parent; the classifier's limit; of an article or main element.
NEAR, SIBLING, LIMIT, CONTENT_WEIGHT = 0.6, 0.8, 3.0, 2.0
#: Weights of elements that are boilerplate, that may be, and of those of which a part of a name says so.
SURE, UNSURE, PARTLY = -5.0, -3.5, -1.0
# Names of HTML and words that sites use for what is not the article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("script style noscript template svg math iframe object canvas audio video head title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = set("nav footer aside form button select option textarea label fieldset menu dialog".split())
CONTENT = {"article", "main"}
WORDS = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer masthead menu modal nav navbar navigation newsletter pagination popup promo promotion "
    "reply replies respond sidebar signup sponsor sponsored contentinfo".split()
)
MAYBE = set("alert banner complementary disclaimer form header notice notices related search share sharing social subscribe toolbar widget widgets".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[^a-z0-9]+")


#: Of WORDS, those that name what readers wrote: an element so named is no wrapper for holding most of the text.
READERS = {"comment", "comments", "discussion", "disqus", "reply", "replies", "respond"}


class Node:
    """An element: its place in the tree, the text below it, what it says of that text, and what all above it say too."""

    __slots__ = ("article", "content", "main", "parent", "said", "size", "tag", "weight", "words")

    def __init__(self, tag: str, parent: int, names: list[str]):
        parts = [[w for w in PART.split(x) if w] for x in names]
        self.tag, self.parent, self.words = tag, parent, frozenset(w for x in parts for w in x)
        weights = [SURE if WORDS.intersection(x) else UNSURE if MAYBE.issuperset(x) else PARTLY if MAYBE.intersection(x) else 0.0 for x in parts if x]
        self.said = min([0.0, *weights, SURE if tag in NOT_CONTENT else PARTLY if tag == "header" else 0.0])
        self.size, self.weight, self.content = 0, 0.0, False
        self.main, self.article = tag == "main", tag == "article" and self.said > SURE


class Block:
    __slots__ = ("features", "links", "parent", "text", "weight", "zone")

    def __init__(self, text: str, links: int, parent: int):
        self.text, self.links, self.parent, self.weight = text, links, parent, 0.0


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order, each with its zone (-1, 0, 1) and features."""
    out: list[Block] = []
    nodes = [Node("", -1, [])]
    path: list[int] = [0]
    opened: Counter = Counter()
    held: list[str] = []
    links, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal links
        if text := " ".join("".join(held).split()):
            out.append(Block(text, min(links, len(text)), path[-1]))
        held.clear()
        links = 0

    def take(raw: str) -> None:
        nonlocal links
        if raw:
            held.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                links += len(held[-1].strip())

    def close() -> str:
        tag = nodes[path.pop()].tag
        opened[tag] -= 1
        return tag

    while m := TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            in_link = not closing
        if name in INLINE:
            continue
        flush()
        if closing:
            if opened[name] > 0:
                while close() != name:
                    pass
        elif name in DROPPED:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if nodes[path[-1]].tag == name and name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
                close()
            names = [w for x in NAMES.finditer(attributes) for w in (x[1] or x[2] or x[3] or "").lower().split()]
            nodes.append(Node(name, path[-1], names))
            path.append(len(nodes) - 1)
            opened[name] += 1
    take(page[at:])
    flush()
    _mark(nodes, out)
    return out


def _mark(nodes: list[Node], found: list[Block]) -> None:
    """Zones and features. Parents come before their children, so one pass up and one down do."""
    for b in found:
        nodes[b.parent].size += len(b.text)
    for n in reversed(nodes[1:]):
        nodes[n.parent].size += n.size
    largest = max((n for n in nodes if n.article), key=lambda n: n.size, default=None)
    marked = [int(n.main or n is largest) for n in nodes]  # such elements below a node, itself included
    for k in range(len(nodes) - 1, 0, -1):
        marked[nodes[k].parent] += marked[k]
    all_text, named = nodes[0].size, [frozenset()] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        above = nodes[n.parent]
        below = marked[k] - int(n.main or n is largest)
        wraps = n.tag in ("html", "body") or below > 0 or 2 * n.size > all_text and marked[k] == marked[0] and not n.words & READERS
        said = 0.0 if wraps or n.tag == "header" and above.content and n.said == PARTLY else n.said
        n.weight = max(2 * SURE, above.weight + said)
        n.content = n.weight > SURE and (above.content or n.tag in CONTENT)
        named[k] = n.words if n.words and not (said < 0 or n.said < 0 and wraps) else named[n.parent]
    for b in found:
        size, n = len(b.text), nodes[b.parent]
        b.weight = n.weight + CONTENT_WEIGHT * n.content
        b.zone = -1 if n.weight <= SURE else 1 if n.content and n.weight == 0 else 0
        end = b.text[-1] in ".!?:;…" or b.text[-1].isdigit()
        b.features = [f"tag:{n.tag}", f"size:{min(12, size.bit_length())}", f"links:{math.ceil(3 * b.links / size)}", f"end:{end}", *(f"name:{w}" for w in sorted(named[b.parent] - WORDS - MAYBE))]


def min_cut(weights: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; weights above 0 pull there, below 0 away.

    A node with two neighbours at most is taken out: the least cost of its two sides, for each choice of theirs, is again
    a pull on each of them and an edge between them. On pages, where a block is joined to those before and after it and to
    those of its parent, this takes out every node; what is left of other graphs is cut by shortest augmenting paths.
    """
    pull = list(weights)
    around: list[dict[int, float]] = [{} for _ in pull]
    for a, b, w in edges:
        if a != b:
            around[a][b] = around[b][a] = around[a].get(b, 0.0) + w
    order, todo, gone = [], [i for i, n in enumerate(around) if len(n) <= 2], [False] * len(pull)
    while todo:
        v = todo.pop()
        if gone[v] or len(around[v]) > 2:
            continue
        gone[v] = True
        links = list(around[v].items())
        order.append((v, links))
        (a, p), (b, q) = (links + [(-1, 0.0)] * 2)[:2]
        x = -pull[v]
        none, both, first, second = min(0.0, x + p + q), min(p + q, x), min(p, x + q), min(q, x + p)
        half = max(0.0, (first + second - none - both) / 2)
        if a >= 0:
            pull[a] -= first - none - half
        if b >= 0:
            pull[b] -= both - first + half
        for n, _ in links:
            del around[n][v]
        if b >= 0 and half > 0:
            around[a][b] = around[b][a] = around[a].get(b, 0.0) + half
        todo += [n for n, _ in links if len(around[n]) <= 2]
    left = [i for i in range(len(pull)) if not gone[i]]
    side = _by_flow(pull, around, left) if left else {}
    for v, links in reversed(order):
        cost = -pull[v] + sum(w if not side[n] else -w for n, w in links)
        side[v] = cost < -1e-12
    return [side[i] for i in range(len(pull))]


def _by_flow(pull: list[float], around: list[dict[int, float]], left: list[int]) -> dict[int, bool]:
    source, sink = len(pull), len(pull) + 1
    cap: dict[int, dict[int, float]] = {i: dict(around[i]) for i in left} | {source: {}, sink: {}}
    for i in left:
        cap[source][i], cap[i][source], cap[i][sink], cap[sink][i] = max(pull[i], 0.0), 0.0, max(-pull[i], 0.0), 0.0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in before:
                    before[j] = i
                    queue.append(j)
        if sink not in before:
            return {i: i in before for i in left}
        trail, j = [], sink
        while j != source:
            trail.append((before[j], j))
            j = before[j]
        flow = min(cap[i][j] for i, j in trail)
        for i, j in trail:
            cap[i][j] -= flow
            cap[j][i] = cap[j].get(i, 0.0) + flow


def graph(found: list[Block], odds: dict[str, float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Weights of blocks, and edges between neighbours."""
    weights = [b.weight + max(-LIMIT, min(LIMIT, sum(odds.get(f, 0.0) for f in b.features))) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        edges += [(before, i, w) for before, w in ((i - 1, NEAR), (last.get(b.parent, -1), SIBLING)) if before >= 0]
        last[b.parent] = i
    return weights, edges


def main_text(page: str | None, odds: dict[str, float]) -> str:
    found = blocks(page or "")
    weights, edges = graph(found, odds)
    return "\n".join(b.text for b, keep in zip(found, min_cut(weights, edges), strict=True) if keep)


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of content for each feature, from the blocks in zones of about sample_pages pages."""
    n = max(1, pages.select(F.count("*")).first()[0])
    few = pages.where(F.xxhash64(id_col, html_col, F.lit(9)).bitwiseAND(2**31 - 1) < int(min(1.0, sample_pages / n) * 2**31)).select(html_col)
    schema = pa.schema([("feature", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for page in b.column(0):
                for x in blocks(page.as_py() or ""):
                    if x.zone:
                        c.update((f, x.zone) for f in x.features)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], schema=schema)

    sums: dict[int, Counter] = {1: Counter(), -1: Counter()}
    for r in few.mapInArrow(count, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect():
        sums[r["label"]][r["feature"]] = r["n"]
    names = sorted(sums[1].keys() | sums[-1].keys())
    good, bad = (sum(s.values()) + len(names) for s in (sums[1], sums[-1]))
    return {f: math.log((sums[1][f] + 1) / good) - math.log((sums[-1][f] + 1) / bad) for f in names}


def extract(pages: DataFrame, odds: dict[str, float], html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text of each whole page; a column of that name gives way."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: main_text(x, odds)).astype(object)

    return pages.withColumn(out_col, run(F.coalesce(F.col(html_col), F.lit(""))))
