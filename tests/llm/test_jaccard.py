import random

import pytest
from helpers import alike, components, frame, near_copies, shingles
from paths import SF

from leadcurve.llm import jaccard as jc


def plain(texts):
    return components(texts, alike(texts))


@pytest.mark.parametrize("seed", [0, 1])
def test_plain_version(spark, seed):
    texts = near_copies(seed)
    got = {r.doc_id: r for r in jc.link_components(frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    want = plain(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in texts.items()}
    assert len(set(want.values())) < len(want)


def test_every_boundary_gives_the_same_links(spark, monkeypatch):
    texts = near_copies(3, groups=4, copies=5, length=16)
    want = plain(texts)
    for boundary in (0, 5, 9):
        monkeypatch.setattr(jc, "choose_boundary", lambda *_, b=boundary: b)
        monkeypatch.setattr(jc, "FREQUENT", 1 if boundary else 16)
        got = jc.link_components(frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_order_table_may_be_full(spark, monkeypatch):
    texts = near_copies(4, groups=6)
    monkeypatch.setattr(jc, "FREQUENCY_TABLE", 3)
    monkeypatch.setattr(jc, "FREQUENT", 2)
    monkeypatch.setattr(jc, "UNIT", 200)
    got = jc.link_components(frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == plain(texts)


def test_large_group_of_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(600):
        copy = list(base)
        copy[rng.randrange(40)] = f"x{i % 37}"
        texts[i] = " ".join(base if i % 3 else copy)
    got = jc.link_components(frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == plain(texts)


def test_nulls_repeats_and_case(spark):
    rows = [(1, "One two three", "a", "b"), (2, "one TWO\tthree", "a", "b"), (3, "one two", None, None), (4, None, None, None), (5, "", None, None), (6, " \n", None, None)]
    rows += [(None, "one two three", None, None), (2, "one TWO\tthree", "a", "b"), (9, "É a b c d", None, None), (8, "é a b c d", None, None), (7, "z " * 60_000 + "end", None, None)]
    docs = frame(spark, rows).selectExpr("*", "1 as node", "2 as n")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.link_components(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (None, 1, 1), (3, 1, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 2, 7), (8, 1, 8), (9, 1, 9)], key=repr)
    assert jc.link_components(frame(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    texts = near_copies(2)
    docs = frame(spark, [(i, t, "x", str(i)) for i, t in texts.items()])
    kept = jc.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain(texts).values()))
    rows = [(1, "a b c", "x", "s"), (1, "a b c", "x", "s"), (1, "d e f", "x", "s"), (2, "d e f", "x", "s"), (3, None, "x", "s"), (3, None, "x", "s"), (None, "g h", "x", "s"), (None, "g h", "y", "s"), (5, "a b c", "x", "s")]
    stays = sorted(((r.doc_id, r.text) for r in jc.deduplicate(frame(spark, rows)).collect()), key=repr)
    assert stays == sorted([(1, "a b c"), (1, "d e f"), (3, None), (3, None), (None, "g h")], key=repr)


def test_boundary_by_cost():
    assert jc.choose_boundary({}, 5.0) == 0
    assert jc.choose_boundary({n: 100 for n in range(1, 17)}, 1.0) < jc.choose_boundary({n: 100 for n in range(1, 17)}, 100.0)


def test_driver_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in jc.link_components(docs).collect()} == plain(texts)
