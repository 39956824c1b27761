"""Ranked lexical search by two trees: one over the items, one over the documents, both with coordinate maxima."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.llm.blocks import blocks
from leadcurve.llm.work import Work, ship, tidy
from leadcurve.sources.local import local_table

#: A term: ASCII letters and digits, and everything beyond ASCII. On bytes of UTF-8, what parts terms.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PARTS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

K = 10
#: Items of a block, and how many cells its matrix of terms and items may have.
ITEMS, CELLS = 256, 1 << 22
#: Documents of a leaf, leaves of a branch, and items or nodes of an item node.
LEAF, BRANCH, FAN = 64, 64, 4
#: Documents, or entries of them, that are put in order together before they are cut into leaves.
GATHER, GATHER_ENTRIES = 4096, 2_000_000
#: Up to so many terms, sums of products of 15 and 20 bits stay whole numbers in doubles.
EXACT = 1 << 18
#: Stands for a null id, which comes first among equals.
NO_ID = -(1 << 63)

LEAVES = "texts bigint, words bigint, seen array<int>, seen_in array<int>, doc_ids array<bigint>, lengths array<bigint>, counts array<int>, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(CAPITALS))


def weight(n_documents: int, holding: int) -> int:
    """Of a term that so many documents hold."""
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


@dataclass
class Items:
    """A block of items: their terms as rows of a vocabulary, and the tree over them.

    ``parents[l]`` has the node of level l + 1 for each node of level l;
    level 0 are the items. ``hashes`` are ascending, ``term`` the vocabulary's
    number of each.
    """

    ids: list[int | None]
    vocabulary: list[str]
    own: list[np.ndarray]
    hashes: np.ndarray
    term: np.ndarray
    #: Terms by the number of items that hold them, rarest first.
    priority: np.ndarray
    parents: list[np.ndarray] = field(default_factory=list)


def item_block(rows: list[tuple[int | None, list[str]]]) -> Items:
    """Items (id, terms) with their vocabulary and tree."""
    vocabulary = sorted({t for _, terms in rows for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    own = [np.array(sorted({number[t] for t in terms}), np.int64) for _, terms in rows]
    held = np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=len(vocabulary))
    hashes = np.zeros(0, np.uint64)
    if vocabulary:
        hashes = np.concatenate([b.word_hashes(*b.words(PARTS)[:2]) for b in blocks(pa.array(vocabulary))])
    order = np.argsort(hashes)
    by_rarity = np.lexsort((hashes, held))
    priority = np.empty(len(vocabulary), np.int64)
    priority[by_rarity] = np.arange(len(vocabulary))
    items = Items([i for i, _ in rows], vocabulary, own, hashes[order], order, priority)
    # items that share their rarest shared terms come together
    shared = [np.sort(priority[t][held[t] > 1])[:3].tolist() for t in own]
    place = np.empty(len(rows), np.int64)
    place[sorted(range(len(rows)), key=lambda i: (shared[i], i))] = np.arange(len(rows))
    width = len(rows)
    while width > 1:
        items.parents.append(place // FAN)
        width = -(-width // FAN)
        place = np.arange(width)
    return items


class Gathered:
    """Documents of a task, as their counts of vocabulary terms, until they are cut into leaves."""

    def __init__(self, items: Items):
        self.items = items
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.counts, self.terms, self.tfs = ([np.zeros(0, np.int64)] for _ in range(5))
        self.texts = self.words = self.entries = self.docs = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        v = max(len(self.items.vocabulary), 1)
        for block in blocks(batch.column("text")):
            begin, end, bounds = block.words(PARTS)
            lengths = np.diff(bounds)
            self.texts += int((lengths > 0).sum())
            self.words += len(begin)
            found = block.word_hashes(begin, end)
            at = np.searchsorted(self.items.hashes, found)
            at[at == len(self.items.hashes)] = 0
            hit = self.items.hashes[at] == found if len(self.items.hashes) else np.zeros(len(found), bool)
            text = np.repeat(np.arange(block.count), lengths)[hit]
            keys, tfs = np.unique(text * v + self.items.term[at[hit]], return_counts=True)
            counts = np.bincount(keys // v, minlength=block.count)
            holds = counts > 0
            self.ids.append(ids[block.first : block.first + block.count][holds])
            self.lengths.append(lengths[holds])
            self.counts.append(counts[holds])
            self.terms.append(keys % v)
            self.tfs.append(tfs)
            self.entries += len(keys)
            self.docs += int(holds.sum())
            if self.docs >= GATHER or self.entries >= GATHER_ENTRIES:
                yield self.leaves()

    def leaves(self) -> pa.RecordBatch:
        """All that was gathered as leaves; the first one also has the sums over the texts, those without terms included."""
        ids, lengths, counts, terms, tfs = (np.concatenate(x) for x in (self.ids, self.lengths, self.counts, self.terms, self.tfs))
        starts = np.cumsum(counts) - counts
        if len(ids):
            # documents with the same rarest terms come together
            rank = self.items.priority[terms]
            first = np.minimum.reduceat(rank, starts)
            spread = (rank * 0x9E3779B1) & 0xFFFFFFFF
            order = np.lexsort((ids, np.minimum.reduceat(spread, starts), first))
            ids, lengths, moved = ids[order], lengths[order], counts[order]
            at = np.repeat(starts[order] - (np.cumsum(moved) - moved), moved) + np.arange(len(terms))
            counts, terms, tfs = moved, terms[at], tfs[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        seen = np.bincount(terms, minlength=len(self.items.vocabulary))
        seen_terms = np.flatnonzero(seen)
        rows = []
        for a in range(0, max(len(ids), 1), LEAF):
            b = min(a + LEAF, len(ids))
            inside = slice(ends[a], ends[b])
            top = (self.texts, self.words, seen_terms, seen[seen_terms]) if a == 0 else (0, 0, [], [])
            rows.append((*top, ids[a:b], lengths[a:b], counts[a:b], terms[inside], tfs[inside]))
        self.clear()
        kinds = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 3
        names = [c.split()[0] for c in LEAVES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def document_leaves(docs: DataFrame, items: Items) -> DataFrame:
    """Every document with a term of the items, in leaves of similar ones, and sums over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(shared.value)
        for batch in batches:
            yield from gathered.add(batch)
        if gathered.texts or gathered.docs:
            yield gathered.leaves()

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(tidy(run), LEAVES)


@dataclass
class Trees:
    """What scores depend on: number and mean length of documents, term weights; and scores that k documents reach, by item."""

    items: Items
    documents: int
    words: int
    weights: np.ndarray
    floor: np.ndarray

    def levels(self) -> list[np.ndarray]:
        """Matrices (term x node) of the largest weight under each node, from the items up."""
        w = np.zeros((len(self.items.vocabulary), len(self.items.own)))
        for i, terms in enumerate(self.items.own):
            w[terms, i] = self.weights[terms]
        out = [w]
        for parent in self.items.parents:
            up = np.zeros((len(w), int(parent.max()) + 1))
            for child, node in enumerate(parent.tolist()):
                np.maximum(up[:, node], w[:, child], out=up[:, node])
            out.append(w := up)
        return out

    def measures(self, lengths: list[int]) -> np.ndarray:
        """m of documents with so many terms."""
        return np.array([100 - 90 + 90 * n * self.documents // self.words for n in lengths], np.int64)


def _product(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact sums of products as doubles that are whole numbers; in two parts where one might round."""
    if c.shape[1] <= EXACT:
        return c @ w
    high = np.floor(c / 1024)
    return (high @ w).astype(np.int64) * 1024 + ((c - high * 1024) @ w).astype(np.int64)


class Leaf:
    """Documents and their term values (10^9 tf) div (1000 tf + 8 m)."""

    def __init__(self, row: dict, trees: Trees):
        counts = np.array(row["counts"], np.int64)
        self.ids = np.array(row["doc_ids"], np.int64)
        self.terms, tf = np.array(row["terms"], np.int64), np.array(row["tfs"], np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.values = (1_000_000_000 * tf) // (1000 * tf + 8 * trees.measures(row["lengths"])[self.doc])

    def maxima(self, size: int) -> np.ndarray:
        out = np.zeros(size)
        np.maximum.at(out, self.terms, self.values)
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Document x item."""
        own, place = np.unique(self.terms, return_inverse=True)
        dense = np.zeros((len(self.ids), len(own)))
        dense[self.doc, place] = self.values
        return _product(dense, w[own])


class Best:
    """The k best documents of each item seen so far, and the score that a further one must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.astype(np.float64), k
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floor]

    def add(self, leaf: Leaf, items: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.floor[items][None, :])
        for column in np.flatnonzero(good.any(0)).tolist():
            item, rows = int(items[column]), good[:, column]
            ids = np.concatenate((self.kept[item][0], leaf.ids[rows]))
            values = np.concatenate((self.kept[item][1], scores[rows, column].astype(np.int64)))
            order = np.lexsort((ids, -values))[: self.k]
            self.kept[item] = ids[order], values[order]
            if len(order) == self.k:
                self.floor[item] = max(self.floor[item], values[order[-1]])

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.kept), dtype=np.int32), [len(ids) for ids, _ in self.kept])
        ids, values = (np.concatenate([x[part] for x in self.kept] + [np.zeros(0, np.int64)]) for part in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(values)], ["item", "doc_id", "score"])


def first_look(branch: list[Leaf], maxima: np.ndarray, levels: list[np.ndarray], best: Best) -> None:
    """Scores, for each item, the leaf of the branch with the highest bound: k real scores early on."""
    bounds = maxima @ levels[0]
    leaf = bounds.argmax(0)
    worth = (bounds.max(0) > 0) & (bounds.max(0) >= best.floor)
    for number in np.unique(leaf[worth]).tolist():
        items = np.flatnonzero(worth & (leaf == number))
        best.add(branch[number], items, branch[number].scores(levels[0][:, items]))


def descend(branch: list[Leaf], maxima: np.ndarray, levels: list[np.ndarray], parents: list[np.ndarray], best: Best) -> None:
    """Scores all pairs of documents and items that the bounds of node pairs leave.

    A bound is the product of both nodes' maxima: no document under the one
    scores higher for an item under the other. A pair goes if that is below
    the weakest k-th score of its items; equal ones stay, as a smaller id
    wins a tie. Pairs of the whole branch go down the item tree first, then
    those of its leaves.
    """
    weakest = [best.floor]
    for parent in parents:
        up = np.full(int(parent.max()) + 1, np.inf)
        np.minimum.at(up, parent, weakest[-1])
        weakest.append(up)

    def down(rows: np.ndarray, allowed: list[np.ndarray] | None) -> list[np.ndarray]:
        """For each level, which pairs (document node x item node) stay."""
        out: list[np.ndarray] = [np.zeros(0)] * len(levels)
        for level in range(len(levels) - 1, -1, -1):
            open_ = np.ones((len(rows), levels[level].shape[1]), bool) if level == len(levels) - 1 else out[level + 1][:, parents[level]].copy()
            if allowed is not None:
                open_ &= allowed[level]
            columns, lines = np.flatnonzero(open_.any(0)), np.flatnonzero(open_.any(1))
            stay = np.zeros_like(open_)
            if len(columns):
                bound = rows[lines] @ levels[level][:, columns]
                stay[np.ix_(lines, columns)] = (bound > 0) & (bound >= weakest[level][columns])
            out[level] = open_ & stay
        return out

    whole = down(maxima.max(0)[None, :], None)
    if not whole[0].any():
        return
    pairs = down(maxima, whole)[0]
    for number in np.argsort(-pairs.sum(1), kind="stable").tolist():
        items = np.flatnonzero(pairs[number])
        if not len(items):
            break
        best.add(branch[number], items, branch[number].scores(levels[0][:, items]))


def _searched(leaves: DataFrame, trees: Trees, k: int, thorough: bool) -> DataFrame:
    """The k best documents of each item in each task; without ``thorough``, of those that a first look meets."""
    shared = leaves.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        levels, best = t.levels(), Best(t.floor, k)
        branch: list[Leaf] = []

        def search() -> None:
            maxima = np.stack([leaf.maxima(len(t.weights)) for leaf in branch])
            if thorough:
                descend(branch, maxima, levels, t.items.parents, best)
            else:
                first_look(branch, maxima, levels, best)
            branch.clear()

        for batch in batches:
            for number in range(batch.num_rows):
                branch.append(Leaf(batch.slice(number, 1).to_pylist()[0], t))
                if len(branch) == BRANCH:
                    search()
        if branch:
            search()
        yield best.rows()

    held = leaves.where("size(doc_ids) > 0").select("doc_ids", "lengths", "counts", "terms", "tfs")
    return held.mapInArrow(tidy(run), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() over (partition by item order by score desc, doc_id asc nulls first)")).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items by blocks: as many as fit ``ITEMS`` and ``CELLS``, one at least."""
    rows: list[tuple[int | None, list[str]]] = []
    size = 0
    for r in items.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").toLocalIterator():
        terms = sorted(Counter(terms_of(r.text)))
        if rows and (len(rows) == ITEMS or (size + len(terms)) * (len(rows) + 1) > CELLS):
            yield item_block(rows)
            rows, size = [], 0
        rows.append((r.item_id, terms))
        size += len(terms)
    if rows:
        yield item_block(rows)


def _block_results(docs: DataFrame, items: Items, work: Work, number: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    leaves = work.keep(document_leaves(docs, items), f"leaves-{number}")
    total = leaves.agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).first()
    texts, words = total.texts or 0, total.words or 0
    holding = np.zeros(len(items.vocabulary), np.int64)
    for r in leaves.where("size(seen) > 0").selectExpr("inline(arrays_zip(seen, seen_in))").groupBy("seen").agg(F.sum("seen_in").alias("n")).collect():
        holding[r.seen] = r.n
    weights = np.array([weight(texts, int(h)) for h in holding], np.float64)
    trees = Trees(items, texts, max(words, 1), weights, np.zeros(len(items.ids)))
    looked = _ranked(_searched(leaves, trees, k, thorough=False), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    for r in looked.where(F.col("n") == k).collect():
        trees.floor[r.item] = r.score
    ranked = _ranked(_searched(leaves, trees, k, thorough=True), k)
    names = local_table(spark, "item int, item_id bigint", list(enumerate(items.ids)))
    result = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
    kept = work.keep(result, f"found-{number}")
    work.drop(f"leaves-{number}")
    return kept


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score.

    Documents (doc_id, text) are read once per block of items and become
    their counts of the items' terms, in leaves of 64 similar documents, with
    the numbers that weights and lengths need. Items of a block have a tree
    of their own. Both trees' nodes stand for the largest value that any
    member has in each term, so the product of two nodes bounds all scores
    below them. A first look scores the most promising leaf of each branch
    for every item; the k-th of these scores, over all tasks, is broadcast,
    one number an item. Then every branch is searched by pairs of nodes, and
    pairs below their items' weakest k-th score are left out as a whole. No
    document that belongs to a result can be among them.

    Terms are compared by 64-bit hashes. Documents with equal scores come in
    ascending order of doc_id, a null id first. Null and empty texts hold no
    terms and are in no result, as are items without a term that any document
    holds. Each row is a document, and each an item: rows alike in both
    columns have places of their own. Tables without rows give no rows; other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    work = Work(spark, "search")
    found = None
    for number, block in enumerate(_item_blocks(items)):
        part = _block_results(docs, block, work, number, k)
        found = part if found is None else found.unionAll(part)
    return local_table(spark, "item_id bigint, rank int, doc_id bigint, score bigint", []) if found is None else found
