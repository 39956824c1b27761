import hashlib
import math
import random

import pytest
from paths import SF
from helpers import frame, words

from leadcurve.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above twice its source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def plain_mix(rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets = plain_targets(sizes)
    taken = []
    for source, size in sizes.items():
        own = [(int(hashlib.md5(f"mix-1|{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16), i, t) for i, t, _, s in rows if s == source]
        every = int(targets[source] // size) if size else 0
        rest, upto, more = targets[source] - every * size, 0, {}
        for value in sorted({h for h, _, _ in own}):
            alike = [len(words(t)) for h, _, t in own if h == value]
            if rest <= 0 or upto >= rest:
                break
            more[value] = min(len(alike), math.floor((rest - upto) / alike[0] + 0.5)) if alike[0] else len(alike)
            upto += sum(alike)
        for h, i, t in own:
            taken.append((i, len(words(t)), size, round(targets[source], 6), len(words(t)) * (every + (more.get(h, 0) > 0))))
            more[h] = more.get(h, 0) - 1
    return sorted(taken, key=repr)


def result(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.times) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), None, rng.choice(["a", "b", "Ä", "Z", None, "hot", "hot", "hot"])) for i in range(300)]
    rows += [(None, "no id here", None, "a"), (None, "nor here", None, "a"), (1, None, None, "b"), (2, "", None, "b"), (5, "twice the same", None, "a"), (5, "twice the same", None, "a")]
    assert result(mixing.mix(frame(spark, rows))) == plain_mix(rows)


def test_near_target_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    for source_size, target in {(r.source_size, r.target) for r in rows}:
        own = [r for r in rows if (r.source_size, r.target) == (source_size, target)]
        assert abs(sum(r.size * r.times for r in own) - target) <= max(r.size for r in own)
        assert all(r.times <= 2 for r in own)


def test_one_source_and_empty_tables(spark):
    one = mixing.mix(frame(spark, [(i, "a b c", None, "s") for i in range(10)])).collect()
    assert {r.target for r in one} == {45.0} and sum(r.size * r.times for r in one) == 45
    assert mixing.mix(frame(spark, [])).collect() == []
    silent = mixing.mix(frame(spark, [(1, None, None, "s"), (2, "", None, None)])).collect()
    assert [(r.size, r.target, r.times) for r in silent] == [(0, 0.0, 0)] * 2


def test_documents_as_often_as_taken(spark):
    rows = [(i, "w " * (i % 7 + 1), "hash", f"s{i % 3}", 7) for i in range(60)]
    docs = frame(spark, rows, "doc_id bigint, text string, hash string, source string, times int")
    taken = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    assert {tuple(r) for r in copies.collect()} <= set(rows)


@pytest.mark.parametrize("copies", [3, 10, 400])
def test_rows_alike_at_the_boundary(spark, copies):
    """A source of alike rows comes as near its target as one of their size allows."""
    rows = [(1, "a b c d e f g", None, "hot")] * copies + [(i, "x " * 7, None, "cold") for i in range(2, 2 + copies)]
    docs = frame(spark, rows).repartition(5)
    found = mixing.mix(docs)
    assert result(found) == plain_mix(rows)
    hot = [r for r in found.collect() if r.source == "hot"]
    assert len(hot) == copies and abs(sum(r.size * r.times for r in hot) - hot[0].target) <= 3.5
    counts = {r.source: r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert counts.get("hot", 0) == sum(r.times for r in hot)
