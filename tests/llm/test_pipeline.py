import hashlib

import public_tokenizers
import sentencepiece
from helpers import alike, components, near_copies, words
from paths import SF
from test_mixing import plain_mix

import __spark_entry__ as contract
import corpus_pipeline as cp
from leadcurve.llm import language, oracle, pii, queries


def test_plain_version(spark, tmp_path):
    """All stages against plain ones, on a table with copies, personal data, nulls and junk."""
    rows = [(i, t + (f" mail{i}@a.example.com" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in near_copies(7, groups=6).items()]
    rows += [(1000, None, "en", "s0", None), (1001, "12 34", "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect())

    model = language.learn(docs)
    texts = {}
    for i, text, *_ in rows:
        _, _, (known,) = model.predict([text or ""])
        if known:
            texts[i] = text
    stay = set(components(texts, alike(texts)).values())
    kept = docs.where(docs.doc_id.isin(sorted(stay)))
    changed = {r.doc_id: r.text for r in pii.replace_entities(kept).collect()}
    assert not any(f"mail{i}@" in t for i, t in changed.items())
    times = {i: taken // size for i, size, _, _, taken in plain_mix([(i, changed[i], None, s) for i, _, _, s, _ in rows if i in changed]) if size}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, n in times.items():
        ids = library.encode(changed[i], add_eos=True)
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] * n
    assert got == sorted(want)
    assert len(got) > 50 and 1000 not in times and 1001 not in times


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(cp.STAGES) == 5
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == [], name


def test_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES) and set(oracle.ORACLE_SQL) <= set(contract.oracle_sql())


def test_words_are_those_of_bytes_split():
    assert words("a\x0bb\x1cc d  e") == ["a", "b\x1cc d", "e"]
