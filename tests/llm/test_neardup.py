import numpy as np
import pytest
from helpers import components

from leadcurve.llm import neardup as nd

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, threshold=0.9):
    """n_links and component of every row whose id is its own, by comparing all pairs."""
    size = max((len(v) for _, v in rows if v), default=1)
    ok = {i: np.array([*v, *[0.0] * (size - len(v))], float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, components(degree, links)


def clustered(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, size))
    vectors = np.repeat(base, 5, axis=0) + spread * rng.normal(size=(n // 5 * 5, size))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("size, spread", [(3, 0.2), (64, 0.3), (16, 0.25)])
def test_plain_version(spark, size, spread):
    rows = clustered(1, 400, size, spread)
    rows += [(1000 + i, list(rows[i][1])) for i in range(40)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), per_cell=40).collect()
    degree, component = plain(rows)
    assert sum(degree.values()) > 100
    if size < 10:
        assert {r.vec_id: r.n_links for r in got} == degree
        assert {r.vec_id: r.component_id for r in got} == component
    else:
        assert sum(r.n_links for r in got) / sum(degree.values()) > 0.99
        assert all(r.n_links <= degree[r.vec_id] for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_exact_with_full_reach(spark):
    rows = clustered(2, 300, 32, 0.32)
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), per_cell=20, reach=6.0).collect()
    degree, component = plain(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], component[i]) for i in degree}


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, *(0.1 * rng.normal(size=7)).tolist()]) for i in range(150)] + [(200 + i, rng.normal(size=8).tolist()) for i in range(60)] + [(300 + i, [0.5] * 8) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), per_cell=30).collect()
    degree, component = plain(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], component[i]) for i in degree}


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0]), (9, [5.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as label", "true as kept")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}
    assert got == alone | {7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 11: (3, 7, False)}
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    repeated = nd.near_duplicates(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0]), (None, None)], SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in repeated), key=repr) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=repr)


def test_low_rank_vectors_in_many_dimensions(spark):
    """Partners differ within the few dimensions that the vectors have; both ends count a link."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(384, 12)))[0].T
    base = rng.normal(size=(600, 12))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    across = rng.normal(size=base.shape)
    across -= (across * base).sum(1, keepdims=True) * base
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cosine = rng.uniform(0.905, 0.95, (600, 1))
    vectors = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * across)) @ basis
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), per_cell=20).collect()
    degree, component = plain(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], component[i]) for i in degree}


def test_cells_in_groups(spark, monkeypatch):
    """Groups of one cell and of several, and cells in parts, count every link once for each end."""
    rows = clustered(4, 500, 24, 0.3)
    degree, component = plain(rows)
    for block in (3, 20, 1500):
        monkeypatch.setattr(nd, "BLOCK", block)
        got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), per_cell=25).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], component[i]) for i in degree}
