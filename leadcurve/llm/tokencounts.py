"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.work import ship, tidy

RULES = ("first", "most")
SCHEMA = (
    "doc_id bigint, section bigint, field string, char_start bigint, char_end bigint, n_tokens bigint, n_touching bigint, n_crossing bigint"
)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    """A byte-level encoder, and the number of bytes of each id."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def token_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens of ``lengths`` bytes, and the number of characters before each byte.

    A token that holds a part of a character spans that whole character.
    """
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = np.zeros(len(starts), np.int64)
    if len(data):
        inside[:] = (data[starts] & 0xC0) == 0x80
    return lead[starts] - inside, lead[ends], lead


def shares(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of token spans with the sections between ``cuts`` (ascending character positions, no empty section).

    Returns per section: tokens allocated, tokens that touch it, tokens that
    touch it and another one. Rule ``first``: a token belongs to the section
    with its first character; ``most``: to the one with most of its
    characters, the earlier one of equals.
    """
    n = len(cuts) - 1
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, end, "left") - 1
    owner = first
    if rule == "most":
        owner = first.copy()
        for i in np.flatnonzero(last > first):
            own = np.minimum(end[i], cuts[first[i] + 1 : last[i] + 2]) - np.maximum(start[i], cuts[first[i] : last[i] + 1])
            owner[i] += int(np.argmax(own))
    crossing = last > first
    edges = np.bincount(first, minlength=n + 1)[: n + 1] - np.concatenate(([0], np.bincount(last, minlength=n)[:n]))
    cross = np.bincount(first[crossing], minlength=n + 1)[: n + 1] - np.concatenate(([0], np.bincount(last[crossing], minlength=n)[:n]))
    return np.bincount(owner, minlength=n)[:n], np.cumsum(edges)[:n], np.cumsum(cross)[:n]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "first") -> DataFrame:
    """Tokens of every section (line) of every field, from one encoding of the document.

    A document is its fields joined by a line feed; its sections are the
    lines, each with the line feed that ends it. The whole is encoded once.
    Byte lengths of the ids give each token's character span, and spans are
    joined to the sections' intervals. ``rule`` says who owns a token that
    touches several (see ``shares``), so the sections' n_tokens add up to the
    document's. One row per section: doc_id, section (from 0), field,
    char_start, char_end (in the whole document), n_tokens, n_touching,
    n_crossing.

    A null field is an empty one. A document without any character gives one
    row of zeros. Repeated rows give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names, ranks_path = list(fields), str(ranks_path)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = encoder(ranks_path, pattern)
        for batch in batches:
            parts, used = [], 0
            for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(_sections(doc_id, [v or "" for v in values], names, encoding, length, rule))
                used += len(parts[-1][1])
                if used > 200_000:
                    yield _rows(parts)
                    parts, used = [], 0
            if parts:
                yield _rows(parts)

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(f"field{i}") for i, c in enumerate(names)]]
    return docs.select(*columns).mapInArrow(tidy(run), SCHEMA)


def _sections(doc_id, values, names, encoding, length, rule):
    whole = "\n".join(values)
    data = np.frombuffer(whole.encode(), np.uint8)
    start, end, lead = token_spans(data, length[encoding.encode_ordinary(whole)] if whole else np.zeros(0, np.int64))
    breaks = lead[np.flatnonzero(data == 10) + 1]
    cuts = np.concatenate(([0], breaks, lead[-1:]))
    if len(cuts) > 2 and cuts[-1] == cuts[-2]:
        cuts = cuts[:-1]
    owned, touching, crossing = shares(start, end, cuts, rule)
    begins = np.cumsum([0] + [len(v) + 1 for v in values[:-1]])
    field = np.searchsorted(begins, cuts[:-1], "right") - 1
    return doc_id, cuts, owned, touching, crossing, [names[i] for i in field]


def _rows(parts) -> pa.RecordBatch:
    counts = [len(p[1]) - 1 for p in parts]
    ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), counts)))
    arrays = [
        ids,
        pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64()),
        pa.array([f for p in parts for f in p[5]], pa.string()),
        *[pa.array(np.concatenate(a), pa.int64()) for a in ([p[1][:-1] for p in parts], [p[1][1:] for p in parts], *([p[i] for p in parts] for i in (2, 3, 4)))],
    ]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "field", "char_start", "char_end", "n_tokens", "n_touching", "n_crossing"])
