import random
from collections import Counter

import numpy as np
from helpers import by_id, frame, words
from paths import SF_CHECKED

from leadcurve.llm import divergence as dv


def plain(text):
    text = text or ""
    found, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    inside = {j for i in range(len(found) - 2) if grams[tuple(found[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside)


def test_base_features(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "語", " ", " ", "\n", "\n", "\t", "#", "|", " ", "a b", "\u000b"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "a", "a\na\na", " a\na\n a\n", "x y z x y z", "x y z\nx y z " * 40_000]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for i, r in by_id(dv.judge(docs)).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[i]), repr(texts[i])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_distance_from_reference(spark):
    rows = [(i, " ".join(random.Random(i).choices(["the", "of", "and", "cat", "dog"], k=300)), "en", None) for i in range(30)]
    rows += [(100, "THE CAT!! " * 30, "en", None), (101, " ".join(f"w{i} v{i}" for i in range(150)), "en", None)]
    docs = frame(spark, rows)
    got = by_id(dv.judge(docs))
    counts, classes = Counter(), np.zeros(dv.CLASSES)
    for _, t, _, _ in rows:
        counts.update(w.lower() for w in words(t))
        classes += np.bincount(dv.CLASS[np.frombuffer(t.encode(), np.uint8)], minlength=dv.CLASSES)
    common = [w for w, n in counts.items() if n >= dv.COMMON_SHARE * sum(counts.values())]

    def distance(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = [sum(a * np.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0) for x in (p, q)]
        return np.sqrt(sum(kl) / 2)

    for i, t, _, _ in rows:
        own = Counter(w.lower() for w in words(t))
        bins = [own[w] for w in common]
        all_bins = [counts[w] for w in common]
        want = distance([*bins, sum(own.values()) - sum(bins)], [*all_bins, sum(counts.values()) - sum(all_bins)])
        assert abs(got[i].word_distance - want) < 1e-9
        assert abs(got[i].class_distance - distance(np.bincount(dv.CLASS[np.frombuffer(t.encode(), np.uint8)], minlength=dv.CLASSES), classes)) < 1e-9
    assert got[0].class_distance < dv.MAX_CLASS_DISTANCE and got[0].word_distance < dv.MAX_WORD_DISTANCE
    assert not got[100].kept and got[100].class_distance > dv.MAX_CLASS_DISTANCE
    assert not got[101].kept and got[101].word_distance > dv.MAX_WORD_DISTANCE


def test_missing_parts(spark):
    clean = " ".join(random.Random(1).choices(["der", "die", "und", "Haus", "Tor", "Rad"], k=120))
    rows = [(1, clean, "de", None), (1, clean, "de", None), (None, clean, None, None), (3, None, "de", None), (4, "", "xx", None), (5, "kurz", None, None)]
    docs = frame(spark, rows).selectExpr("*", "1 as n_words", "true as kept")
    got = dv.judge(docs).collect()
    assert len(got) == 6
    assert [r.base_failed for r in got if r.n_words == 0] == [True, True]
    assert dv.judge(frame(spark, [])).collect() == []
    assert {r.class_distance for r in dv.judge(frame(spark, [(1, clean, None, None)])).collect()} == {0.0}


def test_junk_goes_and_clean_stays(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECKED}/documents.parquet").collect()}
    for i, r in by_id(dv.judge(spark.read.parquet(f"{SF_CHECKED}/documents.parquet"))).items():
        text = docs[i].text
        odd = sum(text.count(c) for c in "#*$%&") > 0.1 * len(text) or sum(c.isupper() for c in text) > 0.3 * len(text)
        plain_text = sum(text.count(c) for c in "#*$%&|") == 0 and sum(c.isupper() for c in text) < 0.1 * len(text)
        if odd and len(text) >= 200:
            assert not r.kept, i
        if plain_text and not r.base_failed:
            assert r.kept, i
