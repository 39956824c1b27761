import numpy as np
import public_tokenizers
import pytest
from helpers import frame
from paths import SF
from tokenizers import Tokenizer

from leadcurve.llm import tokencounts as tc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(values, rule):
    """Token counts of the lines of values joined by line feeds, from the offsets of another library."""
    text = "\n".join(v or "" for v in values)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    spans = tokenizer.encode(text, add_special_tokens=False).offsets
    cuts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    sections = list(zip(cuts[:-1], cuts[1:], strict=True))
    owned, touching = [0] * len(sections), [0] * len(sections)
    for a, b in spans:
        shared = [min(b, y) - max(a, x) for x, y in sections]
        hit = [i for i, n in enumerate(shared) if n > 0]
        for i in hit:
            touching[i] += 1
        owned[hit[0] if rule == "first" else max(hit, key=lambda i: (shared[i], -i))] += 1
    return [(x, y, n, t) for (x, y), n, t in zip(sections, owned, touching, strict=True)]


@pytest.mark.parametrize("rule", tc.RULES)
def test_offsets_of_another_library(spark, rule):
    texts = ["a\n\n\nb\n", "Über\nStraße 語語 😀\n\n\n\nend", "", None, "\n", "one line", "x\n \n  \n\ty <|endoftext|>\n" * 3, "word " * 3000 + "\n" + "z" * 5000]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    got = {}
    for r in tc.count_tokens(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), RANKS, PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.char_start, r.char_end, r.n_tokens, r.n_touching))
    for i, t in enumerate(texts):
        assert [r[1:] for r in sorted(got[i])] == plain([t], rule), repr((t or "")[:80])


def test_fields(spark):
    docs = frame(spark, [(1, "body one\nbody two", "title\n", "s"), (1, None, None, "s"), (None, "x", "t", None)])
    rows = tc.count_tokens(docs.selectExpr("*", "1 as section"), RANKS, PATTERN, fields=("lang", "text")).collect()
    assert [(r.section, r.field) for r in rows if r.doc_id == 1 and r.char_end] == [(0, "lang"), (1, "lang"), (2, "text"), (3, "text"), (0, "lang")]
    assert [(r.field, r.n_tokens) for r in rows if r.doc_id is None] == [("lang", 2), ("text", 1)]


def test_crossing_token_belongs_to_one_section():
    owned, touching, crossing = tc.shares(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 4, 6]), "most")
    assert owned.tolist() == [2, 0, 1] and touching.tolist() == [2, 1, 2] and crossing.tolist() == [1, 1, 1]


def test_empty_table(spark):
    assert tc.count_tokens(frame(spark, []), RANKS, PATTERN).collect() == []
    with pytest.raises(ValueError):
        tc.count_tokens(frame(spark, []), RANKS, PATTERN, rule="any")
