"""Whitening against plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from helpers import frame
from paths import SF

from leadcurve.llm import queries, whitening

VECTORS = "vec_id bigint, embedding array<double>"


def plain(rows):
    """Whole vectors of the rows that take part, the fit list's sums, and its covariance by fractions."""
    whole = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in e)) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({x for _, x in whole})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(x, sums, strict=True)] for x in fit]
    dims = len(sums)
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dims)] for i in range(dims)])
    return whole, n, sums, v


def check(found, rows):
    whole, n, sums, v = plain(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(16, len(sums))
    assert len(found) == k * len(whole)
    by_vector = {}
    for r in found:
        by_vector.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for i, x in whole:
        own = by_vector[i]
        assert sorted(own) == list(range(1, k + 1))
        assert any(r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) and r.n == n for r in own[1])
    for c in range(k):
        if values[c] > 1e-9:
            assert all(math.isclose(r.explained, values[c] / np.trace(v), rel_tol=1e-6) for own in by_vector.values() for r in own[c + 1])
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error <= 1e-4
    # projections keep inner products: w is (x - mean) on unit axes over the root of their variance
    mean = np.array([s / n for s in sums])
    axes = np.linalg.eigh(v)[1][:, ::-1]
    for i, x in whole:
        expected = (np.array(x) - mean) @ axes[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
        for c in range(k):
            gap = min([abs(values[c] - values[o]) for o in range(len(values)) if o != c], default=1)
            if values[c] > 1e-9 and gap > 1e-6 * values[0]:
                assert any(math.isclose(abs(r.whitened), abs(expected[c]), rel_tol=1e-6, abs_tol=1e-7) for r in by_vector[i][c + 1])


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(7, 7))
    rows = [(i, [float(c) for c in rng.normal(size=7) @ mixing]) for i in range(80)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies count once
    found = whitening.whiten(frame(spark, rows, VECTORS)).collect()
    check(found, rows)
    assert {r.n for r in found} == {80}


def test_more_dimensions_than_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=20)]) for i in range(60)]
    check(whitening.whiten(frame(spark, rows, VECTORS)).collect(), rows)


def test_whole_numbers_stay_exact():
    rng = np.random.default_rng(5)
    big = rng.integers(-(1 << 40), 1 << 40, (30, 3))
    sums = [sum(map(int, c)) for c in big.T]
    centre = np.array([s // 30 for s in sums])
    rests = [s - 30 * int(c) for s, c in zip(sums, centre, strict=True)]
    found = whitening.covariance(30, rests, whitening.pair_squares(big - centre))
    exact = [[sum(Fraction(30 * int(r[i]) - sums[i], 30) * Fraction(30 * int(r[j]) - sums[j], 30) for r in big) / 30 for j in range(3)] for i in range(3)]
    assert np.array_equal(found, [[float(c) for c in row] for row in exact])


def test_strange_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (None, [0.3, -2.0])]
    strange = [(3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [1e300, 0.0])]
    df = frame(spark, [(i, e, "x", 1) for i, e in sound + strange], f"{VECTORS}, component string, n int")
    found = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == [(False, 1, 1), (False, 1, 2), (False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    check(found, sound)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_fit(spark, rows):
    found = whitening.whiten(frame(spark, rows, VECTORS))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.collect() == []


def test_no_variance(spark):
    found = whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in found] == [(1, 0, None, None)] * 4
    flat = whitening.whiten(frame(spark, [(1, [0.0, 0.5]), (2, [1.0, 0.5])], VECTORS)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows)
