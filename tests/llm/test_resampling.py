import math
import re
from collections import Counter

import numpy as np
from helpers import frame
from paths import SF_CHECKED

from leadcurve.llm import resampling as rs
from leadcurve.llm.blocks import blocks

TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\U0010ffff]+")


def test_features_are_tokens_and_pairs():
    import pyarrow as pa

    texts = ["a b*** a", "", None, "é!!", "  ", "a b*** a", "x" * 5000 + " y"]
    block = next(blocks(pa.array(texts)))
    found, text = rs.features(block, 1 << 40)
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t or "")
        expected = Counter(tokens) + Counter(zip(tokens[:-1], tokens[1:], strict=True))
        assert sorted(Counter(found[text == i].tolist()).values()) == sorted(expected.values())
    assert sorted(found[text == 0]) == sorted(found[text == 5])


def test_ratio_weight_and_choice(spark):
    rows = [(i, "good words here" if i % 4 else "*** !! ***", None, None) for i in range(400)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(bool(i % 4))) for i in range(0, 200)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in rs.resample(docs, labels).collect()}
    good, bad = 300 * 5, 100 * 5
    b, s = rs.BUCKETS, rs.SMOOTHING
    target_total, raw_total = 150 * 5 + b * s, good + bad + b * s
    want = rs.LENGTH * (math.log((150 + s) / target_total) - math.log((300 + s) / raw_total))
    assert abs(got[1].log_weight - want) < 1e-6
    kept = [i for i, r in got.items() if r.kept]
    assert len(kept) == 300 and all(i % 4 for i in kept)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [int(v) for v in rng.normal(0, 1e9, 3000)] + [7] * 500
    keys = spark.createDataFrame([(v,) for v in values], "key bigint")
    for k in (1, 2, 17, 1500, 3499):
        assert rs.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert rs.kth_largest(keys, 3500) is None


def test_gumbel_top_k_follows_weights(spark):
    """Without a difference between the models all have the same chance."""
    docs = frame(spark, [(i, f"t{i % 3}", None, None) for i in range(3000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id bigint, quality int")
    kept = [r.doc_id for r in rs.resample(docs, labels, length=0).collect() if r.kept]
    assert len(kept) == 1500
    assert all(430 < sum(i % 3 == m for i in kept) < 570 for m in range(3))


def test_nulls_and_empty(spark):
    docs = frame(spark, [(1, None, None, None), (2, "", None, None), (None, "some text", None, None), (3, "some text", None, None), (3, "some text", None, None)]).selectExpr("*", "1 as key", "2 as draw")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, quality int")
    got = sorted(((r.doc_id, r.kept, r.score) for r in rs.resample(docs, none).collect()), key=repr)
    assert got == sorted([(1, False, 0.0), (2, False, 0.0), (None, True, 0.5), (3, True, 0.5), (3, True, 0.5)], key=repr)
    assert rs.resample(frame(spark, []), none).collect() == []


def test_labelled_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECKED}/{t}.parquet") for t in ("documents", "labels"))
    rows = rs.resample(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
    again = rs.resample(docs.repartition(5), labels.repartition(3)).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in rs.resample(docs, labels).where("kept").collect())
