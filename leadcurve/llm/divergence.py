"""Quality rules by distribution divergence: character classes and common words against language references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.blocks import IS_SPACE, Block, blocks, sorted_sets, windows
from leadcurve.llm.work import Work, ship, tidy

SYMBOLS = b"#*$%&|<>"
#: Classes of characters: small, capital, other script or accented, digit, blank, line feed, punctuation, symbol, rest.
CLASSES = 9
CLASS = np.full(256, 8, np.uint8)
for _members, _class in (
    (range(0x61, 0x7B), 0), (range(0x41, 0x5B), 1), (range(0x80, 0x100), 2), (range(0x30, 0x3A), 3),
    (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:!?'\"()-", 6), (SYMBOLS, 7),
):
    CLASS[list(_members)] = _class

#: A word is common in a language if it makes up this share of its words: at most 1 / share words are.
COMMON_SHARE = 1 / 400
#: Shorter texts are too short for a distance to mean anything; they pass.
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.4

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def base_features(block: Block, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules, one entry per text."""
    data, starts = block.data, block.starts
    solid = ~IS_SPACE[data]
    leading = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _per_text(solid & leading, starts),
        "n_symbols": _per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), starts),
    }
    # lines: between line feeds and text ends
    edges = np.unique(np.concatenate((starts[:-1], np.flatnonzero(data == 10) + 1)))
    edges = edges[edges < len(data)]
    ends = np.append(edges[1:], len(data))[: len(edges)]
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    filled = np.concatenate(([0], np.cumsum(solid)))
    worded = filled[ends] > filled[edges]
    edges, ends = edges[worded], ends[worded]
    lines = np.searchsorted(edges, starts)
    _, distinct = sorted_sets(block.word_hashes(edges, ends, lower=False), lines)
    out["n_dup_lines"] = np.diff(lines) - np.diff(distinct)
    # words in three-word windows that the text holds twice
    grams, at = windows(block.word_hashes(begin, end, lower=False), bounds, 3)
    text = np.repeat(np.arange(block.count), np.diff(at))
    order = np.lexsort((grams, text))
    same = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    word = np.flatnonzero(twice) + 2 * text[twice]  # each earlier text with windows has two more words than windows
    word += (bounds[:-1] - at[:-1] - 2 * np.arange(block.count))[text[twice]]
    inside = np.zeros(len(begin) + 2, bool)
    for i in range(3):
        inside[word + i] = True
    out["n_repeat_words"] = _per_text(inside[: len(begin)], bounds)
    return out


def class_counts(block: Block) -> np.ndarray:
    """Characters of each class, one row per text."""
    leading = (block.data & 0xC0) != 0x80
    text = np.repeat(np.arange(block.count), np.diff(block.starts))[leading]
    counts = np.bincount(text * CLASSES + CLASS[block.data[leading]], minlength=block.count * CLASSES)
    return counts.reshape(block.count, CLASSES)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (square root of the divergence in bits) of rows of counts from a reference; 0 for rows without any."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def part(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.where(p.sum(-1) > 0, np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0)


def _count_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, kind (0 class, 1 word), key, count of each block."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        code, names = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for block in blocks(batch.column("text")):
            begin, end, bounds = block.words()
            hashes = block.word_hashes(begin, end)
            classes = class_counts(block)
            own = code[block.first : block.first + block.count]
            of_word = np.repeat(own, np.diff(bounds))
            for i, name in enumerate(names):
                if not (own == i).any():
                    continue
                words, counts = np.unique(hashes[of_word == i], return_counts=True)
                sums = classes[own == i].sum(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (len(words) + CLASSES), pa.string()),
                        pa.array(np.repeat(np.array([0, 1], np.int32), [CLASSES, len(words)])),
                        pa.array(np.concatenate((np.arange(CLASSES), words.view(np.int64)))),
                        pa.array(np.concatenate((sums, counts)).astype(np.int64)),
                    ],
                    ["lang", "kind", "key", "n"],
                )


def language_references(docs: DataFrame, share: float = COMMON_SHARE) -> list[tuple[str, int, int, int]]:
    """Counts of every language over all its documents: rows lang, kind, key, n.

    Classes (kind 0) all; words (kind 1) only those that make up ``share`` of
    the language's words; the rest of its words under kind 2. So at most 1 /
    share + 10 rows a language come to the driver. Words are counted by hash,
    block by block, before the shuffle.
    """
    work = Work(docs.sparkSession, "references")
    ship(docs.sparkSession)
    parts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null").mapInArrow(tidy(_count_corpus), "lang string, kind int, key bigint, n bigint")
    counts = work.keep(parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "counts")
    totals = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.where("kind = 1").join(totals, "lang").where(F.col("n") >= share * F.col("total")).select("lang", "kind", "key", "n")
    rows = [tuple(r) for r in counts.where("kind = 0").unionByName(common).collect()]
    total = {r.lang: r.total for r in totals.collect()}
    known = {lang: sum(n for a, kind, _, n in rows if a == lang and kind == 1) for lang in total}
    work.drop("counts")
    return sorted(rows + [(lang, 2, 0, total[lang] - known[lang]) for lang in total])


class References:
    """What the rows of ``language_references`` say, as arrays."""

    def __init__(self, rows):
        self.langs = sorted({r[0] for r in rows})
        self.classes = np.zeros((len(self.langs), CLASSES))
        self.words, self.word_counts = [], []
        for i, lang in enumerate(self.langs):
            for _, kind, key, n in rows:
                if _ == lang and kind == 0:
                    self.classes[i, key] = n
            common = sorted((np.int64(key).view(np.uint64), n) for a, kind, key, n in rows if a == lang and kind == 1)
            self.words.append(np.array([w for w, _ in common], np.uint64))
            self.word_counts.append(np.array([n for _, n in common] + [sum(n for a, kind, _, n in rows if a == lang and kind == 2)], float))

    def distances(self, i: int, classes, hashes, text, count) -> tuple[np.ndarray, np.ndarray]:
        common = self.words[i]
        at = np.searchsorted(common, hashes) if len(common) else np.zeros(len(hashes), np.int64)
        hit = common[np.minimum(at, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
        bins = len(common) + 1
        words = np.bincount(text * bins + np.where(hit, at, bins - 1), minlength=count * bins).reshape(count, bins)
        return jensen_shannon(classes, self.classes[i]), jensen_shannon(words, self.word_counts[i])


def judge(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    share: float = COMMON_SHARE,
) -> DataFrame:
    """Base counts, Jensen-Shannon distances and a verdict for every whole text.

    A document's histograms of character classes and of common words are
    held against the references of its language; one without a language,
    against those of every language, and the nearest counts. kept is false if
    the base rules fail (fewer than 50 words, or more than half of them in
    repeated three-word windows), or if the class distance (texts of
    ``min_chars`` on) or the word distance (texts of ``min_words`` on) is
    above its limit.

    A null text is an empty one: all counts 0, base failed. Without any
    reference (an empty table, or no language known) distances are 0.
    Repeated rows give repeated rows. Languages are expected to be few, their
    references go to every task.
    """
    ship(docs.sparkSession)
    rows = language_references(docs, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References(rows)
        place = {lang: i for i, lang in enumerate(references.langs)}
        for batch in batches:
            own = np.array([place.get(lang, -1) for lang in batch.column("lang").to_pylist()], np.int64)
            for block in blocks(batch.column("text")):
                begin, end, bounds = block.words()
                out = base_features(block, begin, end, bounds)
                n = out["n_words"]
                hashes, classes = block.word_hashes(begin, end), class_counts(block)
                text = np.repeat(np.arange(block.count), n)
                lang = own[block.first : block.first + block.count]
                far = np.zeros((2, block.count)) if not place else np.full((2, block.count), np.inf)
                for i in range(len(place)):
                    mine = (lang == i) | (lang < 0)
                    if mine.any():
                        take = mine[text]
                        renumber = np.cumsum(mine) - 1
                        far[:, mine] = np.minimum(far[:, mine], references.distances(i, classes[mine], hashes[take], renumber[text[take]], int(mine.sum())))
                failed = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
                odd = (classes.sum(1) >= min_chars) & (far[0] > max_class_distance) | (n >= min_words) & (far[1] > max_word_distance)
                arrays = [batch.column("doc_id").slice(block.first, block.count), *(pa.array(out[c].astype(np.int64)) for c in FEATURES)]
                arrays += [pa.array(a) for a in (failed, far[0], far[1], ~(failed | odd))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *FEATURES, "base_failed", "class_distance", "word_distance", "kept"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
