import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from helpers import frame
from paths import SF

from leadcurve.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    decoded = library.decode(ids)
    return len(ids), ids, decoded, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_as_the_library(spark, library):
    rng = random.Random(4)
    alphabet = [*"ab c  \n\téß語😀 　\x00-<s>/", "  ", "▁", "▁▁", " the", "</s>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "  ", "▁", "a ", " a", "x" * 20_000, "word " * 20_000, " " * 3000]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pieces.encode(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), MODEL).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_tokens, list(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) == expected(library, t), repr(t)


def test_a_full_table_starts_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_SIZE", 5)
    table = pieces.WordTable(MODEL)
    for text in ("a b c d", "e f a b", "a b c d e f g h i j", "a"):
        assert [i for r in table.look_up(text) for i in r[0]] == library.encode(text)


def test_each_distinct_word_once(monkeypatch):
    table, added = pieces.WordTable(MODEL), []
    monkeypatch.setattr(table, "add", lambda words, add=table.add: (added.extend(words), add(words)))
    table.look_up("one two one  two")
    table.look_up("two one")
    assert sorted(added) == sorted(set(added))


def test_repeats_and_columns(spark):
    docs = frame(spark, [(1, "a", None, None), (1, "a", None, None), (None, "a", None, None)]).selectExpr("*", "7 as n_tokens", "'x' as ids")
    got = pieces.encode(docs, MODEL, ("ids_sha256",))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256"]
    assert [(r.doc_id, r.n_tokens) for r in got.collect()] == [(1, 2), (1, 2), (None, 2)]
    assert pieces.encode(frame(spark, []), MODEL).collect() == []
