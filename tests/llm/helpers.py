"""Plain versions of what several operators share."""

from __future__ import annotations

import random
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id bigint, text string, lang string, source string"


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    found = words((text or "").translate(CAPITALS))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)])


def components(nodes, links):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def alike(texts):
    """Pairs of ids whose sets have a Jaccard similarity of 3/4 or more."""
    sets = {i: s for i, t in texts.items() if (s := shingles(t))}
    return [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def near_copies(seed, groups=12, copies=6, length=60):
    """Texts in groups of copies with a few words changed, and texts of few words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(1, length))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += shared
            if rng.random() < 0.2:
                copy = copy * 2
            texts.append(" ".join(copy))
    short = [" ".join(rng.choices("abcdef", k=rng.randint(1, 14))) for _ in range(150)]
    texts += short
    rng.shuffle(texts)
    return dict(enumerate(texts))
