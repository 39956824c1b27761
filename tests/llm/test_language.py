import base64

import numpy as np
from helpers import frame
from paths import SF, SF_CHECKED
from pyspark.sql import functions as F

from leadcurve.llm import language, queries


def grams(text):
    """n-grams of orders 1 to 3 over letters in lower case and single blanks."""
    shown = " "
    for c in text:
        if c.isalpha():
            shown += c.lower()
        elif shown[-1] != " ":
            shown += " "
    return {shown[i : i + n] for n in (1, 2, 3) for i in range(len(shown) - n + 1)} - {" "}


def test_kernel_is_shared_ngrams():
    texts = ["Aba, c!", "abacus über", "", "1 2", "xyz"]
    model = language.fit([("a", texts[0]), ("b", texts[1])])
    kernels, has_letter = model.kernels(texts)
    assert has_letter.tolist() == [True, True, False, False, True]
    for i, t in enumerate(texts):
        for j, mark in enumerate(texts[:2]):
            # x, y and z are the same unknown letter to the model
            mine = {g.translate(str.maketrans("xyz", "???")) for g in grams(t)}
            want = len(mine & grams(mark)) / np.sqrt(max(len(mine), 1) * len(grams(mark)))
            assert abs(kernels[i, j] - want) < 1e-6


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECKED}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op2_language"](spark, SF_CHECKED).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_undetermined_and_empty(spark):
    rows = [(1, "the cat and the hat " * 5, "en", "s"), (2, "der Hund und die Katze " * 5, "de", "s"), (3, None, "en", "s"), (4, "", None, None), (5, "123 !!", "en", None), (None, "und die Katze", None, None), (1, "the hat", None, "t")]
    docs = frame(spark, rows)
    model = language.learn(docs)
    found = sorted(((r.doc_id, r.lang_pred, r.score > 0.5) for r in language.identify(docs.withColumn("score", docs.lang), model).collect()), key=repr)
    assert found == [(1, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "de", True)]
    kept = language.keep_identified(docs, model).collect()
    assert sorted(((r.doc_id, r.lang) for r in kept), key=repr) == [(1, "en"), (1, "en"), (2, "de"), (None, "de")]
    nothing = language.learn(frame(spark, []))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language.training_sample(docs, per_lang=5, max_chars=2000)
    assert sample == language.training_sample(docs.repartition(5), per_lang=5, max_chars=2000)
    assert all(sum(own == lang for own, _ in sample) <= 5 for lang, _ in sample) and all(len(t) <= 2000 for _, t in sample)


def test_very_long_text(spark):
    rows = [(i, t * 40_000, lang, None) for i, (t, lang) in enumerate([("the cat and hat ", "en"), ("der Hund und Tor ", "de")])] + [(7, "the hat", "en", None), (8, "der Tor", "de", None)]
    docs = frame(spark, rows)
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()}
    assert found == {0: "en", 1: "de", 7: "en", 8: "de"}


def test_strange_texts_go(spark):
    """Unlearned scripts, gibberish and encoded data go with any number of languages; clean texts stay."""
    docs = spark.read.parquet(f"{SF_CHECKED}/documents.parquet")
    rng = np.random.default_rng(1)
    strange = ["Это предложение написано на русском языке", "これは日本語の文章です。残ってはいけません。", "語", rng.bytes(300).hex(), base64.b64encode(rng.bytes(300)).decode()]
    strange += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(k)) for k in (10, 200)]
    rows = frame(spark, [(-1 - i, t, "en", "s") for i, t in enumerate(strange)])
    for learned in (docs, docs.where("lang in ('en', 'de')"), docs.withColumn("lang", F.expr("concat(lang, doc_id % 2)"))):
        model = language.learn(learned)
        kept = language.keep_identified(docs.select("doc_id", "text", "lang", "source").unionByName(rows), model)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert not [strange[-1 - i][:40] for i in ids if i < 0]
        own = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").join(learned.where("lang is not null").select("doc_id").distinct(), "doc_id").select("doc_id").collect()}
        assert len(own - ids) <= 0.005 * len(own)
        # a prediction all the same
        named = {r.lang_pred for r in language.identify(rows, model).collect()}
        assert named and named <= set(model.langs)


def test_lettered_texts_have_a_learned_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    texts = ["Hello my friend, how are you today?", "DNA", "Это предложение написано на русском языке", "これは日本語の文章です", "qzx wvk jjq", "a", "語", "x" * 50_000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(100, "12 -- 3.", None, None), (101, " ", None, None)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows), model).collect()}
    assert all(found[i][0] in model.langs and 0 <= found[i][1] <= 1 for i in range(len(texts)))
    assert found[100] == found[101] == ("und", 0.0)


def test_many_letters(spark):
    """Two languages of 2500 letters each, none shared: all of them tell, not the frequent ones alone."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(map(chr, rng.integers(0x4E00 + 2500 * (i % 2), 0x4E00 + 2500 * (i % 2 + 1), 12))), "ab"[i % 2], "s") for i in range(900)]
    docs = frame(spark, rows)
    model = language.learn(docs.where("doc_id < 500"))
    assert model.table is None and len(model.letters) > 2000
    found = {r.doc_id: r.lang_pred for r in language.identify(docs.where("doc_id >= 500"), model).collect()}
    # texts that share no letter with a landmark cannot be told
    marks = set("".join(sorted(t for i, t, _, _ in rows if i < 500)))
    told = [i for i in found if set(rows[i][1]) & marks]
    assert sum(found[i] == rows[i][2] for i in told) / len(told) > 0.85


def test_tables_and_searches_agree(monkeypatch):
    sample = [("a", "the cat sat on the mat"), ("b", "der hund lief nach haus")] * 3
    texts = ["the hund", "xyz", "on der mat", "ж"]
    dense = language.fit(sample)
    monkeypatch.setattr(language, "TABLE_CODES", 0)
    sparse = language.fit(sample)
    assert dense.table is not None and sparse.table is None
    assert np.allclose(dense.kernels(texts)[0], sparse.kernels(texts)[0]) and dense.predict(texts)[0] == sparse.predict(texts)[0]


def test_sample_of_many_languages(spark):
    docs = frame(spark, [(i, f"word{i}", f"l{i % 400}", None) for i in range(12_000)])
    sample = language.training_sample(docs)
    assert len({lang for lang, _ in sample}) == 400 and len(sample) <= 400 * language.SAMPLE_LEAST
