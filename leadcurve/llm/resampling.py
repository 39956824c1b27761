"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.blocks import IS_SPACE, Block, blocks, scramble
from leadcurve.llm.work import Work, ship, tidy

BUCKETS = 10_000
SMOOTHING = 1.0
#: Ids of the target set that are learned from, those with the lowest hashes.
MAX_TARGETS = 20_000
#: Log weights are those of a text of so many n-grams, whatever its length.
LENGTH = 100
SEED = "resample-1"
STEPS = 1000
MICRO = 1_000_000

#: Kinds of bytes: blank, part of a word (letters, digits, other scripts), other signs.
KIND = np.full(256, 2, np.uint8)
KIND[IS_SPACE] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def features(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all single tokens and pairs of a block, and the text each is of.

    A token is a run of word characters or of other signs, as it is written.
    """
    kind = KIND[block.data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[block.starts] = True
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    solid = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[solid], end[solid]
    hashes = block.word_hashes(begin, end, lower=False)
    text = np.searchsorted(block.starts, begin, "right") - 1
    pair = scramble(hashes[:-1] * np.uint64(0x100000001B3) + hashes[1:])
    inside = text[1:] == text[:-1]
    # an empty text starts where the next one does: the last of equal starts is the text of a token
    return (np.concatenate((hashes, pair[inside])) % np.uint64(buckets)).astype(np.int64), np.concatenate((text, text[1:][inside]))


def fit(docs: DataFrame, targets: list[int], buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket.

    Raw counts are over all documents, target counts over those named in
    ``targets``. Each task counts its texts and passes on one row per bucket.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(set(targets)), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            wanted = np.isin(ids, known) & ~np.asarray(batch.column("doc_id").is_null())
            for block in blocks(batch.column("text")):
                found, text = features(block, buckets)
                counts[0] += np.bincount(found, minlength=buckets)
                counts[1] += np.bincount(found[wanted[block.first : block.first + block.count][text]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *map(pa.array, counts)], ["bucket", "raw", "target"])

    sums = docs.select("doc_id", "text").mapInArrow(tidy(count), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in sums:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, length: int = LENGTH, seed: str = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight and key (log weight plus Gumbel noise, in millionths) of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            draw = batch.column("draw").to_numpy()
            for block in blocks(batch.column("text")):
                found, text = features(block, len(ratio))
                n = np.bincount(text, minlength=block.count)
                weight = length * np.bincount(text, ratio[found], minlength=block.count) / np.maximum(n, 1)
                noise = -np.log(-np.log(draw[block.first : block.first + block.count]))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        pa.array(n),
                        pa.array(weight, mask=none),
                        pa.array(np.floor((weight + noise) * MICRO).astype(np.int64), mask=none),
                    ],
                    ["doc_id", "n_grams", "log_weight", "key"],
                )

    draw = F.expr(f"(pmod(xxhash64('{seed}', doc_id, text), {1 << 52}L) + 0.5D) / {1 << 52}D").alias("draw")
    return docs.select("doc_id", "text", draw).mapInArrow(tidy(run), "doc_id bigint, n_grams bigint, log_weight double, key bigint")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of column key, by histograms of ever smaller range; None if there are no more than k rows."""
    low, high, n = keys.selectExpr("min(key)", "max(key)", "count(key)").first()
    if n <= k or k <= 0:
        return None
    above = 0
    while low < high:
        width = (high - low) // STEPS + 1
        rows = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"cast(floor((key - {low}) / {width}) as bigint)").alias("step")).count().collect()
        for step, count in sorted(((r.step, r["count"]) for r in rows), reverse=True):
            if above + count >= k:
                low, high = low + step * width, min(high, low + (step + 1) * width - 1)
                break
            above += count
    return low


def resample(docs: DataFrame, labels: DataFrame, length: int = LENGTH, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_grams, log_weight, score and kept of every document (doc_id, text).

    Target text are the documents that ``labels`` (doc_id, quality) call good
    (quality 1); at most MAX_TARGETS of them are learned from. Raw text are
    all documents. The log ratio of both models, averaged over a document's
    n-grams, is its log weight. A sample without replacement, with chances by
    weight, are the k rows with the highest log weight plus Gumbel noise; k
    is the number of documents times the good ones' share of the labels. The
    noise depends on seed, id and text: reruns agree. score is the log weight
    as a logistic value.

    A null text, or one without a token, has no weight (null, score 0) and is
    not kept. Rows alike share their noise; rows tied for the last place are
    all kept. Without labels every ratio is 0 and everything with a token is
    kept. Labels that repeat an id count once, good if any says so.
    """
    work = Work(docs.sparkSession, "resample")
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    good, total = known.selectExpr("count_if(quality = 1)", "count(*)").first()
    targets = [r.doc_id for r in known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGETS).collect()]
    scored = work.keep(weigh(docs, fit(docs, targets, buckets), length, seed), "scored")
    k = round(scored.count() * (good / total if total else 1))
    last = kth_largest(scored, k)
    kept = "key is not null" if last is None else f"coalesce(key >= {last}, false)"
    return scored.selectExpr("doc_id", "n_grams", "log_weight", "coalesce(1 / (1 + exp(-log_weight)), 0D) as score", f"{kept} as kept")
