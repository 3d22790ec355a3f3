"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A classifier, trained on
blocks whose semantic elements tell their kind, and hints of the enclosing
elements give each block a cost of being kept and of being dropped; these are
the capacities to the two terminals. ``nav``, ``aside``, ``form`` and an article
settle a block. Class words and other elements weigh more than the classifier
can, unless the element holds most of a page without an article: then it wraps
the content and its weight falls to nothing. Blocks that follow each other, or
that are children of one element, are joined by smoothness edges. The minimum
cut, found by maximum flow, labels the blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.session import table_path

_TAG = re.compile(r"""<!--(?:.*?-->|.*+)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
SKIP = frozenset("script style noscript template title textarea select option button svg math iframe object canvas audio video datalist head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements a new one of the same set closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that settle that a block goes, ``aside`` and ``nav`` also an article inside, and those that only point to it.
PLAIN_DROP, FIRM_DROP, SOFT_DROP = frozenset(["form"]), frozenset("aside nav".split()), frozenset("header footer dialog menu search".split())
#: Elements whose text is a child of the element around them.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre".split())
WORDS_DROP = frozenset("""ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer disqus footer gdpr header
 login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager paginate pagination popup promo promoted promotion recommended
 related share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget""".split())
WORDS_READERS = frozenset("comment comments commentlist reply replies respond".split())
#: Words beside those that leave an element named for readers' comments alone, which settles it.
WORDS_PLAIN = frozenset("area body box container form item list section text thread wrap wrapper".split())
WORDS_KEEP = frozenset("article".split())
ROLES_DROP = frozenset("alert alertdialog banner contentinfo dialog menu menubar search".split())

#: Log odds of a block under a firm hint, and the most that the classifier says.
HINT, CLIP = 8.0, 4.0
#: Log odds towards drop for each unit of a soft hint, before the element's share of the page
#: is counted: a class word has one unit, an element of SOFT_DROP and readers' comments two.
#: And those towards keep for a class word that names an article.
SOFT, SOFT_KEEP = 5.0, 2.5
#: Weights of the edges between blocks.
NEXT_SAME, NEXT_OTHER, SIBLING = 1.0, 0.25, 0.5
#: Pages (about) that the classifier is fitted on, and the blocks of them at most.
TRAIN_PAGES, TRAIN_BLOCKS = 1000, 50_000


class Hint(NamedTuple):
    """``kind``: 1 keep, 0 unknown, -1 drop, -2 drop an article inside too;
    ``soft``: (number, units towards drop, below 0 towards keep) of the two
    innermost elements with soft hints; ``readers``: inside readers' comments; ``label``: the kind that
    elements, not class words, tell the classifier's training."""

    kind: int = 0
    soft: tuple[tuple[int, int], ...] = ()
    readers: bool = False
    label: int = 0


class Block:
    __slots__ = ("parts", "links", "tag", "parent", "hint")

    def __init__(self, tag: str, parent: int, hint: Hint):
        self.parts, self.links, self.tag, self.parent, self.hint = [], 0, tag, parent, hint


def _hint(tag: str, attrs: str, hint: Hint, number: int) -> Hint:
    """Hint of the element ``number`` inside one of ``hint``."""
    if hint.kind == -2:
        return hint
    words, role, hidden = set(), "", False
    for name, value in _ATTR.findall(attrs) if attrs and attrs != "/" else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(w.lower() for w in _TOKEN.findall(value))
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            hidden = hidden or name == "hidden" or value.lower() == "true"
    if tag in FIRM_DROP or hidden or role in ("navigation", "complementary"):
        return Hint(-2, label=-1)
    more = lambda units: (*hint.soft, (number, units))[-2:]
    if words & WORDS_READERS and tag not in ("body", "html", "main"):
        if words <= WORDS_READERS | WORDS_PLAIN:
            return Hint(-1, readers=True, label=min(0, hint.label))
        return Hint(min(0, hint.kind), more(2), True, min(0, hint.label))
    if tag in ("article", "main") or role in ("article", "main"):
        return hint if hint.readers else Hint(1, label=1)
    if tag in ("body", "html"):
        return hint
    if tag == "header" and hint.kind == 1:
        return hint
    if tag in PLAIN_DROP or role == "form":
        return Hint(-1, readers=hint.readers, label=-1)
    if tag in SOFT_DROP or role in ROLES_DROP:
        return Hint(min(0, hint.kind), more(2), hint.readers, -1)
    if tag not in BLOCK and hint.soft and hint.kind != 1:
        return hint
    if words & WORDS_DROP:
        return Hint(min(0, hint.kind), more(1), hint.readers, min(0, hint.label))
    return Hint(soft=more(-1)) if words & WORDS_KEEP and hint == Hint() else hint


class _Stack:
    """Open elements (tag, number, hint, skipped), the places of each tag, of
    block-level elements and of those that an unmatched end tag does not close,
    so that no step looks through the elements between."""

    EDGES = frozenset(["article", "main", "body"])

    def __init__(self):
        self.open: list[tuple[str, int, Hint, bool]] = [("", 0, Hint(), False)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.edges = [0], [0]

    def push(self, tag: str, number: int, hint: Hint, skipped: bool) -> None:
        at = len(self.open)
        self.open.append((tag, number, hint, skipped))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in self.EDGES:
            self.edges.append(at)

    def cut(self, at: int) -> bool:
        """Close the element at this place and all in it; whether a hint ended."""
        changed = False
        while len(self.open) > at:
            last = len(self.open) - 1
            tag, _, hint, _ = self.open.pop()
            changed = changed or hint != self.open[-1][2]
            self.places[tag].pop()
            for list_ in (self.blocks, self.edges):
                if list_[-1] == last:
                    list_.pop()
        return changed

    def end(self, tag: str) -> bool:
        """An end tag: closes the innermost element of its name, if there is one
        and, unless the tag is such a one itself, inside the innermost article."""
        found = self.places.get(tag)
        if not found or (self.edges[-1] > found[-1] and tag not in self.EDGES and tag != "html"):
            return False
        return self.cut(found[-1])

    def close(self, tags: set[str]) -> None:
        """Close the innermost block-level element if it is one of ``tags``."""
        if self.open[self.blocks[-1]][0] in tags:
            self.cut(self.blocks[-1])

    def holder(self) -> tuple[str, int]:
        """Tag of the innermost block-level element, and the number of the element that text in it is a child of."""
        tag = self.open[self.blocks[-1]][0]
        at = self.blocks[-2] if tag in LEAF else self.blocks[-1]
        return tag, self.open[at][1]


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; text inside one has its references decoded."""
    out: list[Block] = []
    stack = _Stack()
    now, number, link, at, n = None, 0, False, 0, len(page)

    def text(raw: str) -> None:
        nonlocal now
        if stack.open[-1][3] or not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        if now is None:
            if not raw.strip():
                return
            now = Block(*stack.holder(), stack.open[-1][2])
            out.append(now)
        now.parts.append(raw)
        if link:
            now.links += len(raw.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK:
            now, link = None, False
        elif name == "br":
            text(" ")
        elif name == "a":
            link = not closing
        if closing:
            if stack.end(name):
                now = None
            continue
        if name in VOID:
            continue
        if stack.open[-1][0] == "head" and name in BLOCK:
            stack.cut(len(stack.open) - 1)
        if name in BLOCK:
            stack.close(CLOSES.get(name, {"p"}))
        if not attrs.endswith("/") or name in BLOCK:
            number += 1
            around = stack.open[-1]
            hint = _hint(name, attrs, around[2], number)
            if hint != around[2]:
                now = None
            stack.push(name, number, hint, around[3] or name in SKIP)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    return out


def _text(b: Block) -> str:
    return " ".join("".join(b.parts).split())


def features(found: list[tuple[Block, str]]) -> list[list[float]]:
    """What the classifier sees of the blocks of a page: their text, links and
    neighbours, and no tag, as an advert's paragraph has the same as the article's."""
    own = []
    for b, text in found:
        n, words = max(1, len(text)), text.split()
        lower = sum(w[0].islower() for w in words) / max(1, len(words))
        own.append((math.log1p(n), min(1.0, b.links / n), min(10, text.count(",")) / 10, float(text[-1:] in ".!?…:\"»”"), lower))
    rows, last = [], len(own) - 1
    for i, x in enumerate(own):
        near = [own[j] for j in (i - 1, i + 1) if 0 <= j <= last]
        longest, fewest_links = max((y[0] for y in near), default=0.0), min((y[1] for y in near), default=0.0)
        rows.append([1.0, *x, longest, fewest_links, abs(2 * (i + 0.5) / (last + 1) - 1)])
    return rows


#: Weights before any sample: longer text of sentences, fewer links, such a neighbour, less at the page's ends.
PRIOR = np.array([-2.2, 0.45, -4.0, 0.5, 1.0, 0.5, 0.15, -1.0, -0.5])


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (keep) of the cut of least cost: dropping a block costs its
    positive log odds, keeping it its negative ones, an edge between different
    labels its weight. Maximum flow by shortest augmenting levels."""
    n = len(odds)
    if not n or min(odds) >= 0 or max(odds) < 0:
        return [o >= 0 for o in odds]
    s, t = n, n + 1
    to, cap, graph = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i, o in enumerate(odds):
        arc(s, i, o, 0.0) if o >= 0 else arc(i, t, -o, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, u = [], s
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                e = path.pop()
                u = to[e ^ 1]
                continue
            path.append(e)
            u = to[e]


def _soft(found: list[tuple[Block, str]]) -> list[float]:
    """Log odds that soft hints give each block. An element counts in full if
    the page has an article, which is never under a soft hint, or if it holds
    half of the undecided text or less; from there on less, and nothing if it
    holds all: it is the wrapper of the content."""
    size = [len(t) for _, t in found]
    article = any(b.hint.kind > 0 for b, _ in found)
    every = sum(n for (b, _), n in zip(found, size) if not b.hint.kind)
    inside: dict[int, int] = {}
    for (b, _), n in zip(found, size):
        for element, _ in () if b.hint.kind else b.hint.soft:
            inside[element] = inside.get(element, 0) + n
    weight = {e: 1.0 if article else min(1.0, 2 * (1 - n / every)) for e, n in inside.items()}
    told = lambda e, units: -SOFT * units * weight[e] if units > 0 else SOFT_KEEP * -units
    return [0.0 if b.hint.kind else sum(told(*x) for x in b.hint.soft) for b, _ in found]


def extract(page: str, weights: np.ndarray) -> list[str]:
    """Texts of the kept blocks."""
    found = [(b, t) for b in blocks(page) if (t := _text(b))]
    if not found:
        return []
    score = np.array(features(found)) @ weights
    odds = [max(-CLIP, min(CLIP, float(x))) + HINT * max(-1, b.hint.kind) + soft for x, (b, _), soft in zip(score, found, _soft(found))]
    edges, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_SAME if b.parent == found[i - 1][0].parent else NEXT_OTHER))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return [t for keep, (_, t) in zip(min_cut(odds, edges), found) if keep]


def train(pages: DataFrame) -> np.ndarray:
    """Weights of the classifier from about TRAIN_PAGES pages, picked by the
    digest of their html, and at most TRAIN_BLOCKS blocks of them, the first by
    digest and place, labelled by the enclosing elements; class words label none. Blocks of one kind alone
    tell nothing: PRIOR stays. The driver gets the feature rows alone."""
    every = max(1, pages.count() // TRAIN_PAGES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, p in zip(b.column("digest").to_pylist(), b.column("html").to_pylist()):
                found = [(k, t) for k in blocks(p or "") if (t := _text(k))]
                rows += [(digest, i, float(k.hint.label > 0), x) for i, ((k, _), x) in enumerate(zip(found, features(found))) if k.hint.label]
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["digest", "i", "y", "x"])

    picked = pages.select("html", F.xxhash64("html").alias("digest")).where(F.pmod("digest", F.lit(every)) == 0)
    found = picked.mapInArrow(work, "digest long, i int, y double, x array<double>")
    rows = found.orderBy("digest", "i", "x").limit(TRAIN_BLOCKS).collect()
    if len({r.y for r in rows}) < 2:
        return PRIOR.copy()
    return fit(np.array([r.x for r in rows]).reshape(-1, len(PRIOR)), np.array([r.y for r in rows]))


def main_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, html, ...) to (page_id, url, text), a row for each row.

    Blocks are joined by a newline; ``br`` is white space. Null, empty or
    boilerplate-only html gives an empty text; broken markup is read as far as
    it goes; null ids and repeated rows are kept; other columns are ignored;
    empty in, empty out. Each page is handled alone, in memory of its size."""
    w = train(pages) if weights is None else weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(extract(p or "", w)) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(work, "page_id long, url string, text string")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(table_path(sf_dir, "pages")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
