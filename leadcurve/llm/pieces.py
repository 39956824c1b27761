"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadcurve.llm.work import ship, tidy

MARK = "▁"
#: A marked word: a run of markers and what follows up to the next marker.
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries of a task's table; half of them are the words met last, the other half those met before.
TABLE_SIZE = 150_000
#: Characters of texts whose new words are segmented in one call.
GROUP_CHARS = 500_000
#: Rows are passed on when they hold so many tokens.
OUT_TOKENS = 500_000


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces of {model} cross a whitespace marker, as {crossing[0]!r} does")
    return sp


class Words:
    """Distinct marked words by number: the ids of all, one after another, and what each decodes to."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.decoded: list[str] = []

    def append(self, words: list[str], counts: np.ndarray, ids: np.ndarray, decoded: list[str]) -> None:
        self.number.update(zip(words, range(len(self.decoded), len(self.decoded) + len(words)), strict=True))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids))
        self.decoded += decoded

    def take(self, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all."""
        at = np.array(numbers, np.int64)
        counts = self.bounds[at + 1] - self.bounds[at]
        return counts, self.ids[np.repeat(self.bounds[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


class WordTable:
    """Each distinct marked word with its ids and what they decode to.

    When half the table is full of words met since the last time, the words
    not met since then go.
    """

    def __init__(self, model: str):
        self.sp = processor(model)
        self.alone = self.sp.piece_to_id(MARK)
        self.end = self.sp.eos_id()
        self.rows, self.before = Words(), Words()

    def add(self, words: list[str]) -> None:
        # encode() puts a marker in front itself
        encoded = [ids or [self.alone] for ids in self.sp.encode([w[1:] for w in words], num_threads=1)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, counts.sum())
        self.rows.append(words, counts, ids, self.sp.decode(encoded, num_threads=1))

    def look_up_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """Of each text the words' numbers of ids, the ids of all, and what each word decodes to, by position.

        Words new to the table are segmented in one call.
        """
        words = [MARKED_WORD.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        distinct = dict.fromkeys(chain.from_iterable(words))
        missing = [w for w in distinct if w not in self.rows.number]
        if len(self.rows.number) + len(missing) > TABLE_SIZE // 2:
            self.before, self.rows = self.rows, Words()
            missing = list(distinct)
        known = [w for w in missing if w in self.before.number]
        if known:
            numbers = [self.before.number[w] for w in known]
            self.rows.append(known, *self.before.take(numbers), [self.before.decoded[i] for i in numbers])
        new = [w for w in missing if w not in self.before.number]
        if new:
            self.add(new)
        for own in words:
            numbers = [self.rows.number[w] for w in own]
            yield *self.rows.take(numbers), [self.rows.decoded[i] for i in numbers]

    def look_up(self, text: str) -> list[tuple[list[int], str]]:
        """One text's words by position, each with its ids and what it decodes to."""
        counts, ids, decoded = next(self.look_up_all([text]))
        return [(part.tolist(), word) for part, word in zip(np.split(ids, np.cumsum(counts)[:-1]), decoded, strict=False)]


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of GROUP_CHARS characters together, or one longer text."""
    group, chars = [], 0
    for text in texts:
        text = text.as_py() or ""
        if group and chars + len(text) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


_KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}


def _add(out: dict[str, list], ids: np.ndarray, words: list[str], end: int) -> None:
    """Appends one document, given its ids and its decoded words, to the columns asked for."""
    out["n_tokens"].append(len(ids) + 1)
    if "ids" in out:
        out["ids"].append(np.append(ids, np.int32(end)))
    if "ids_sha256" in out:
        out["ids_sha256"].append(_sha256(" ".join(map(str, [*ids.tolist(), end]))))
    decoded = " ".join(words)  # a word's own marker became the space
    if "decoded" in out:
        out["decoded"].append(decoded)
    if "decoded_sha256" in out:
        out["decoded_sha256"].append(_sha256(decoded))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, model: str, want: tuple[str, ...] = ("ids", "decoded", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """Every whole text as the library encodes it, with an end id only, and decoded again.

    Returns doc_id, n_tokens and the columns asked for: ids, decoded (the
    text that the ids give), and the SHA-256 of the ids as decimals joined by
    a space and of the decoded text.

    No piece of the model has a marker after another character, so no merge
    crosses from one marked word into the next and each word can be encoded
    by itself. Every task keeps a table of the distinct words it has met and
    joins their ids back by position; a word is segmented once while it is in
    the table, together with the other new words of some documents. A null
    or empty text gives the end id alone. A text without spaces is one word,
    however long. Repeated rows give repeated rows. The model's path must
    exist on every executor; it is read once per worker.
    """
    model = str(model)
    ship(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint" + "".join(f", {c} {'array<int>' if c == 'ids' else 'string'}" for c in want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        for batch in batches:
            first, at, out, tokens = 0, -1, {c: [] for c in ("n_tokens", *want)}, 0
            for group in _groups(batch.column("text")):
                for _, ids, words in table.look_up_all(group):
                    at += 1
                    _add(out, ids, words, table.end)
                    tokens += out["n_tokens"][-1]
                    if tokens > OUT_TOKENS or at == batch.num_rows - 1:
                        columns = [pa.array(out[c], _KINDS.get(c, pa.string())) for c in out]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at + 1 - first), *columns], ["doc_id", *out])
                        first, out, tokens = at + 1, {c: [] for c in out}, 0

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(tidy(run), schema)
