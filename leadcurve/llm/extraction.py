"""Main text of pages: a tree-structured graphical model over DOM nodes, solved by sum-product messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadcurve.llm import dom
from leadcurve.llm.layouts import labelled_pages
from leadcurve.llm.work import ship, tidy

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
#: Pages that the default model learns from.
TRAINING_PAGES = 700
#: Nodes and characters of pages that go through the model together.
BATCH_NODES, BATCH_CHARS = 50_000, 4_000_000

#: States of a node: all of its text is the article's, some of it, none.
CONTENT, MIXED, OTHER = range(3)
STATES = 3

#: Elements with a potential of their own, by group; all others are one more.
GROUPS = (
    ("#page",), ("html",), ("body",), ("head",), ("article",), ("main",), ("section",), ("div", "center"), ("header",), ("nav", "menu"), ("footer",), ("aside",), ("form", "fieldset", "search", "label", "input"),
    ("p",), ("h1",), ("h2", "h3"), ("h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr"), ("td", "th", "caption"), ("blockquote", "pre", "figure", "figcaption"), ("a",),
    ("b", "i", "em", "strong", "span", "u", "code", "small", "sub", "sup", "font"), ("dialog", "details", "summary", "address"), tuple(sorted(dom.SILENT)), (dom.TEXT,),
)
GROUP_OF = {name: number for number, names in enumerate(GROUPS) for name in names}
N_GROUPS = len(GROUPS) + 1

#: Words of class, id and role by what they tell, looked for in this order; a node without them has number 0, one with other words only the last.
KEYWORDS = (
    ("comment", "comments", "replies", "reply", "discussion", "responses", "disqus"),
    ("ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "paywall"),
    ("nav", "navbar", "navigation", "menu", "topnav", "breadcrumb", "breadcrumbs", "tabs", "pagination"),
    ("header", "masthead", "topbar", "top", "branding", "logo"),
    ("footer", "bottom", "copyright", "colophon", "legal", "contentinfo"),
    ("sidebar", "aside", "widget", "rail", "related", "popular", "recommended", "complementary", "read", "column"),
    ("share", "social", "follow", "tags", "toolbar", "sharing"),
    ("search", "newsletter", "subscribe", "signup", "login", "form"),
    ("article", "content", "entry", "main", "post", "story", "text", "body"),
)
KEYWORD_OF = {word: number for number, words in enumerate(KEYWORDS, 1) for word in words}
N_KEYWORDS = len(KEYWORDS) + 2
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
N_HIDDEN = 2

LENGTHS = np.array([1, 25, 80, 250, 800])
LINKED = np.array([0.01, 0.3, 0.7])
N_AMOUNTS = (len(LENGTHS) + 1) * (len(LINKED) + 1)
SHARES = np.array([0.02, 0.1, 0.4])
ENDS = np.array([0.001, 0.05, 0.15])
N_PROSE = (len(SHARES) + 1) * (len(ENDS) + 1)
FEATURES = (N_GROUPS, N_KEYWORDS, N_HIDDEN, N_AMOUNTS, N_PROSE)
#: Steps of learning, their length, and what holds potentials small.
ROUNDS, RATE, RIDGE = 100, 0.15, 1e-4
#: An element that is all one thing has nothing of the other in it (parent's state x child's state).
RULES = np.array([[0, -1e4, -1e4], [0, 0, 0], [-1e4, -1e4, 0]])
STOP = re.compile(r"[.!?。！？](?=\s|\Z)")


def _keyword(attributes: dict[str, str]) -> int:
    words = [w.lower() for key in ("class", "id", "role") if key in attributes for w in CAMEL.split(attributes[key]) if w]
    if not words:
        return 0
    known = [KEYWORD_OF[w] for w in words if w in KEYWORD_OF]
    return min(known, default=N_KEYWORDS - 1)


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))


@dataclass
class Forest:
    """Trees of several pages as arrays: parent (-1 of a root), depth, page, group, observed values (node x feature)."""

    trees: list[dom.Tree]
    parent: np.ndarray
    depth: np.ndarray
    starts: np.ndarray
    group: np.ndarray
    observed: np.ndarray

    def levels(self) -> Iterator[np.ndarray]:
        """Nodes by depth, the deepest first."""
        order = np.argsort(-self.depth, kind="stable")
        edges = np.flatnonzero(np.diff(self.depth[order])) + 1
        return iter(np.split(order, edges))


def forest(trees: list[dom.Tree]) -> Forest:
    starts = np.concatenate(([0], np.cumsum([len(t.names) for t in trees])))
    parent = np.array([p + s if p >= 0 else -1 for t, s in zip(trees, starts[:-1].tolist(), strict=True) for p in t.parents], np.int64)
    depth = np.array([d for t in trees for d in t.depths], np.int64)
    names = [n for t in trees for n in t.names]
    attributes = [a for t in trees for a in t.attributes]
    group = np.array([GROUP_OF.get(n, N_GROUPS - 1) for n in names], np.int64)
    texts = [x for t in trees for x in t.texts]
    # characters, linked characters, words and ends of sentences below every node
    below = np.zeros((len(names), 4))
    below[:, 0] = [len(x) if not x.isspace() else 0 for x in texts]
    below[:, 2] = [x.count(" ") + 1 if x and not x.isspace() else 0 for x in texts]
    below[:, 3] = [len(STOP.findall(x)) if x else 0 for x in texts]
    out = Forest(trees, parent, depth, starts, group, np.zeros((len(names), len(FEATURES)), np.int64))
    levels = list(out.levels())
    linked = group == GROUP_OF["a"]
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        linked[inner] |= linked[parent[inner]]
    below[:, 1] = np.where(linked, below[:, 0], 0)
    for level in levels:
        inner = level[parent[level] >= 0]
        np.add.at(below, parent[inner], below[inner])
    total = np.repeat(below[starts[:-1], 0], np.diff(starts))
    amount = np.searchsorted(LENGTHS, below[:, 0], "right") * (len(LINKED) + 1) + np.searchsorted(LINKED, below[:, 1] / np.maximum(below[:, 0], 1), "right")
    prose = np.searchsorted(SHARES, below[:, 0] / np.maximum(total, 1), "right") * (len(ENDS) + 1) + np.searchsorted(ENDS, below[:, 3] / np.maximum(below[:, 2], 1), "right")
    out.observed[:] = np.stack([group, [_keyword(a) for a in attributes], [_hidden(a) for a in attributes], amount, prose], 1)
    return out


def labels(f: Forest) -> np.ndarray:
    """States of all nodes out of the labels of marked elements; -1 for nodes without text."""
    names = [n for t in f.trees for n in t.names]
    marks = [a.get("data-label") for t in f.trees for a in t.attributes]
    texts = [x for t in f.trees for x in t.texts]
    inside = np.zeros(len(names), bool)
    content, other = np.zeros(len(names), bool), np.zeros(len(names), bool)
    levels = list(f.levels())
    for level in reversed(levels):
        for node in level.tolist():
            p = f.parent[node]
            inside[node] = marks[node] == "content" if marks[node] else p >= 0 and inside[p]
            if names[node] == dom.TEXT and not texts[node].isspace():
                content[node], other[node] = inside[node], not inside[node]
    for level in levels:
        inner = level[f.parent[level] >= 0]
        np.logical_or.at(content, f.parent[inner], content[inner])
        np.logical_or.at(other, f.parent[inner], other[inner])
    return np.where(content & other, MIXED, np.where(content, CONTENT, np.where(other, OTHER, -1)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials over an axis of the states."""
    parts = [x.take(i, axis) for i in range(STATES)]
    most = np.maximum(np.maximum(parts[0], parts[1]), parts[2])
    return most + np.log(sum(np.exp(part - most) for part in parts))


def _counted(places: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``weights`` by place."""
    flat = weights.reshape(len(weights), -1)
    return np.stack([np.bincount(places, flat[:, i], size) for i in range(flat.shape[1])], 1).reshape(size, *weights.shape[1:])


@dataclass
class Model:
    """Logarithms of potentials: of a root's states, of a parent's and a child's states by the child's and by the parent's element, of observed values by state."""

    root: np.ndarray
    edges: np.ndarray
    under: np.ndarray
    values: list[np.ndarray]

    def parts(self) -> list[np.ndarray]:
        return [self.root, self.edges, self.under, *self.values]

    def solve(self, f: Forest, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each node's state probabilities given its whole page; those of its and its parent's states together, of the nodes with a parent.

        Messages from the leaves up, then back down. ``known`` has the states
        that are given, -1 where none is.
        """
        own = sum(self.values[i][:, f.observed[:, i]] for i in range(len(FEATURES))).T
        if known is not None:
            own = np.where((known[:, None] >= 0) & (known[:, None] != np.arange(STATES)), -1e9, own)
        levels = list(f.levels())
        up, sent, pair = own.copy(), np.zeros_like(own), np.zeros((len(own), STATES, STATES))
        for level in levels:
            inner = level[f.parent[level] >= 0]
            # parent's state x child's state, with what comes from below
            pair[inner] = self.edges[f.group[inner]] + self.under[f.group[f.parent[inner]]] + RULES + up[inner][:, None, :]
            sent[inner] = _log_sum(pair[inner], 2)
            np.add.at(up, f.parent[inner], sent[inner])
        belief = np.empty_like(up)
        for level in reversed(levels):
            roots, inner = level[f.parent[level] < 0], level[f.parent[level] >= 0]
            belief[roots] = up[roots] + self.root
            # what the parent knows but for this child
            pair[inner] += (belief[f.parent[inner]] - sent[inner])[:, :, None]
            belief[inner] = _log_sum(pair[inner], 1)
            total = _log_sum(belief[level], 1)[:, None]
            belief[level] -= total
        inner = np.flatnonzero(f.parent >= 0)
        both = pair[inner] - _log_sum(_log_sum(pair[inner], 2), 1)[:, None, None]
        return np.exp(belief), inner, np.exp(both)

    def expected(self, f: Forest, known: np.ndarray | None = None) -> list[np.ndarray]:
        """How often each potential is met, in expectation."""
        belief, inner, both = self.solve(f, known)
        pairs = [_counted(of, both, N_GROUPS) for of in (f.group[inner], f.group[f.parent[inner]])]
        return [belief[f.parent < 0].sum(0), *pairs, *(_counted(f.observed[:, i], belief, size).T for i, size in enumerate(FEATURES))]


def train(pages: list[str], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Potentials out of labelled pages (``data-label``, as of ``layouts``).

    Climbs the conditional likelihood of the labels: its slope is how often
    a potential is met given the labels, less how often it is met without
    them, both from the messages. Nodes without text have no label.
    """
    model = Model(np.zeros(STATES), *(np.zeros((N_GROUPS, STATES, STATES)) for _ in range(2)), [np.zeros((STATES, size)) for size in FEATURES])
    if not pages:
        return model
    f = forest([dom.parse(p) for p in pages])
    state = labels(f)
    slopes = [np.zeros_like(x) for x in model.parts()]
    sizes = [np.zeros_like(x) for x in model.parts()]
    for step in range(1, rounds + 1):
        for x, slope, size, seen, free in zip(model.parts(), slopes, sizes, model.expected(f, state), model.expected(f), strict=True):
            g = (seen - free) / len(pages) - ridge * x
            slope += 0.1 * (g - slope)
            size += 0.01 * (g * g - size)
            x += rate * (slope / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-6)
    return model


def main_texts(model: Model, trees: list[dom.Tree]) -> list[str]:
    """The blocks of every page whose texts are rather content than not, joined by an empty line."""
    f = forest(trees)
    content = model.solve(f)[0][:, CONTENT] >= 0.5
    out = []
    for tree, start in zip(trees, f.starts[:-1].tolist(), strict=True):
        blocks: dict[int, list[str]] = {}
        for node, name in enumerate(tree.names):
            if name == dom.TEXT and (content[start + node] or tree.texts[node].isspace()):
                blocks.setdefault(tree.blocks[node], []).append(tree.texts[node])
        joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        out.append("\n\n".join(b for b in joined if b))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages(TRAINING_PAGES))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Each page's whole html becomes a tree of elements and texts. A node has a
    state (all, some or none of its text is the article's) with potentials
    for its element, its class, id and role words, whether it is hidden, its
    amount of text and links and how far that is prose, and a potential
    between its and its parent's state by element. Messages go up and down
    each tree once, which gives exact marginals; texts whose marginal of
    being the article's is a half or more are kept. Potentials are learned
    from labelled pages (``train``), by default from made-up layouts.

    Character references are decoded, runs of white space in a block become
    one blank, blocks keep their order and are joined by two line ends; line
    breaks are white space. A null or empty html, or one without main text,
    gives an empty text. Rows stay as many as they are, whatever repeats or
    is null; extra columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            trees: list[dom.Tree] = []
            size = chars = 0
            for html in batch.column("html"):
                trees.append(dom.parse(html.as_py()))
                size += len(trees[-1].names)
                chars += sum(map(len, trees[-1].texts))
                if size > BATCH_NODES or chars > BATCH_CHARS:
                    texts += main_texts(shared.value, trees)
                    trees, size, chars = [], 0, 0
            if trees:
                texts += main_texts(shared.value, trees)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(tidy(run), SCHEMA)
