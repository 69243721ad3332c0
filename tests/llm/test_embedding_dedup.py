import numpy as np
import pytest

from boxmill.llm import embedding_dedup
from boxmill.llm.embedding_dedup import near_vectors
from tests.llm.plain import smallest_reachable

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def plain(rows):
    good = [(i, np.array(v, np.float64), k) for i, v, k, *_ in rows if k is not None and v is not None and not any(c is None for c in v) and np.isfinite(v).all() and np.any(v)]
    links = []
    for a, (i, v, k) in enumerate(good):
        for j, w, m in good[a + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
    root = smallest_reachable([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    return sorted((i, degree[i], root[i], i == root[i]) for i in degree)


def clouds(rng, n, dim=16):
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            v = centre + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.15, 0.3])
            rows.append((int(rng.integers(10**9)), [float(np.float32(c)) for c in v], int(rng.integers(2)), "x"))
    return rows


@pytest.mark.parametrize("leaf", [512, 25])
def test_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rows = clouds(np.random.default_rng(5), 500)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    want = plain(rows)
    found, there = (sum(x[1] for x in y) for y in (got, want))
    assert there > 500 and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert got == want if leaf == 512 else found >= 0.97 * there


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1, ""), (2, [1.0, 0.0], 1, ""), (3, [2.0, 0.0], 1, ""), (4, [1.0, 0.0], 2, ""), (5, [1.0, 0.0], None, ""), (6, None, 1, ""), (7, [0.0, 0.0], 1, ""), (8, [nan, 1.0], 1, ""), (10, [inf, 1.0], 1, ""), (11, [1.0, None], 1, ""), (12, [1.0], 1, ""), (13, [-1.0, 0.0], 1, ""), (14, [], 1, "")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    linked = {9: (9, 2, 2, False), 2: (2, 2, 2, True), 3: (3, 2, 2, False)}
    assert got == [linked.get(i, (i, 0, i, True)) for i in sorted(r[0] for r in rows)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    unnamed = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, ""), (2, [1.0, 0.0], 1, "")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in unnamed) == [(0, 0, 0, True), (0, 0, 0, True), (2, 0, 2, True)]
    twice = near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 2 + [(2, [1.0, 2.0], 0, "")], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links) for r in twice) == [(1, 1), (1, 1), (2, 1)]


def test_group_of_near_vectors_larger_than_a_leaf(spark, monkeypatch):
    """Every two of the group are links, none are bit-equal, and the group is many leaves and blocks long."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    monkeypatch.setattr(embedding_dedup, "FINISH", 700)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 150)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + 0.1 * rng.normal(size=(400, 32)), rng.normal(size=(800, 32))])
    rows = [(i, [float(np.float32(c)) for c in v], 1, "x") for i, v in enumerate(x)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows) and got[5][1] == 399


@pytest.mark.parametrize("finish", [1 << 16, 300])
def test_recall_at_the_threshold_around_a_common_direction(spark, monkeypatch, finish):
    """Pairs of cosine 0.94 or a little more among vectors with a mean direction, over many levels of splits, within tasks or the upper ones by Spark."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 48)
    monkeypatch.setattr(embedding_dedup, "FINISH", finish)
    rng = np.random.default_rng(9)
    dim, n = 64, 700
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(2 * np.sqrt(dim) * unit(rng.normal(size=dim)) + rng.normal(size=(n, dim)))
    across = rng.normal(size=(n, dim))
    across = unit(across - (across * x).sum(axis=1, keepdims=True) * x)
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * across
    both = np.concatenate([x, y])
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(both)], SCHEMA)).collect()}
    want = (both @ both.T >= 0.93).sum(axis=1) - 1
    share = sum(got.values()) / want.sum()
    assert want.sum() >= 2 * n - 20 and share >= 0.995
