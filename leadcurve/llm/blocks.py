"""Whole texts of an Arrow batch as flat numpy arrays: words, their hashes, their shingles.

A batch is cut into blocks of a few megabytes of text (a longer text is a
block of its own), so the arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

#: Bytes that part words: space and 0x09 to 0x0D. The same set as bytes.split().
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, BLOCK_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= BLOCK_BYTES:
            _POWERS[base] = known
    return known


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Block:
    """Consecutive texts of a batch.

    first, count: their rows; data: their UTF-8 bytes; starts: where each
    text begins in data, and at last its length.
    """

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray):
        self.first, self.data, self.starts = first, data, starts
        self.count = len(starts) - 1

    def words(self, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words before each text (one more entry than texts).

        ``parts`` says of each byte whether it parts words.
        """
        solid = ~parts[self.data]
        before = np.empty(len(solid), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        edge = self.starts[:-1][self.starts[:-1] < len(solid)]
        before[edge] = False
        begin = np.flatnonzero(solid & ~before)
        after = np.empty(len(solid), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[edge[edge > 0] - 1] = False
        end = np.flatnonzero(solid & ~after) + 1
        return begin, end, np.searchsorted(begin, self.starts)

    def word_hashes(self, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, A-Z as a-z if asked for."""
        n = len(self.data)
        letters = _RANDOM[LOWER] if lower else _RANDOM
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(letters[self.data] * _powers(_BASE, n)[:n], out=sums[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        return scramble((sums[end] - sums[begin]) * back[begin])


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, in order, and the number before each text."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    mixed = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x100000001B3) + hashes[i : i + len(mixed)]
    per_text = np.maximum(np.diff(bounds) - (size - 1), 0)
    counts = np.concatenate(([0], np.cumsum(per_text)))
    at = np.repeat(bounds[:-1] - counts[:-1], per_text) + np.arange(counts[-1])
    return scramble(mixed[at]), counts


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values in ascending order without repeats, and the number before each text."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(values)]] = True
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column as blocks of at most ``limit`` bytes or one text. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield Block(at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to
