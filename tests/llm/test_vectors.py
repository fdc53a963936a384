"""Embedding near-duplicates against brute force: links, classes, audit, splitting, defined cases."""

import numpy as np
import pytest

from webloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (low == label).all():
            break
        label = low
    return {i: (int(n), ids[c]) for i, n, c in zip(ids, near.sum(axis=1), label)}


def clustered(rng, groups, noise, dims=24):
    return np.concatenate([rng.standard_normal(dims) + noise * rng.standard_normal((g, dims)) for g in groups]).astype(np.float32)


@pytest.mark.parametrize("shard", [4096, 60])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "CLUSTER", 150)
    rng = np.random.default_rng(4)
    x = clustered(rng, [1] * 250 + [2] * 40 + [9] * 6 + [70], 0.1)
    x = np.concatenate([x, x[:20], x[-5:]])  # exact copies
    ids = [int(i) for i in rng.permutation(len(x))]
    order = np.argsort(ids)
    want = brute([ids[i] for i in order], x[order].astype(float), 0.95)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in zip(ids, x)], SCHEMA)
    rows = vectors.near_duplicates(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    found, truth = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * truth
    assert sum(got[i][1] != want[i][1] for i in want) <= 0.01 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows) and rows[0].recall >= 0.9


def test_range_search_finds_all_in_range():
    rng = np.random.default_rng(0)
    x = vectors.unit(clustered(rng, [1] * 100 + [40], 0.1).astype(float))
    kept = vectors.robust_prune(x)
    assert max(map(len, kept)) <= vectors.DEGREE
    both = [set(k) for k in kept]
    for i, k in enumerate(kept):
        for j in k:
            both[j].add(i)
    flat = np.full((len(x), max(map(len, both))), -1)
    for i, k in enumerate(both):
        flat[i, :len(k)] = sorted(k)
    seen = vectors.range_search(x, flat, np.arange(len(x)), 0.9, 24)
    truth = x @ x.T >= 0.9
    assert (seen & truth).sum() >= 0.99 * truth.sum()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0]), (10, [-1.0, 0.0]), (10, [-3.0, 0.0]), (None, [1.0, 0.001]), (11, [1e-30, 0.0]), (12, [0.0, 3e38])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()], key=str)
    want = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12)] + [(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (11, 3, 1, False),
                                                                   (10, 1, 10, True), (10, 1, 10, True)]
    assert got == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    only_bad = vectors.near_duplicates(df.where("vec_id in (3, 4)")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only_bad) == [(3, 0, 3, True), (4, 0, 4, True)]


def _graph(x):
    """Pruned neighbours of unit vectors, both ways, padded with -1."""
    both = [set() for _ in x]
    for i, kept in enumerate(vectors.robust_prune(x)):
        for j in kept:
            both[i].add(int(j))
            both[int(j)].add(i)
    flat = np.full((len(x), max(map(len, both))), -1)
    for i, near in enumerate(both):
        flat[i, :len(near)] = sorted(near)
    return flat


def test_groups_without_singles_between_them():
    """25 groups of 130 near copies: each is an island of the graph, and there are more of them than medoids."""
    rng = np.random.default_rng(6)
    x = vectors.unit(clustered(rng, [130] * 25, 0.05).astype(float))
    seen = np.concatenate([vectors.range_search(x, graph, rows, 0.9, 24) for graph in [_graph(x)] for rows in np.array_split(np.arange(len(x)), 13)])
    truth = x @ x.T >= 0.95
    assert (seen & truth).sum() >= 0.999 * truth.sum()


def test_brute_force_after_the_last_round(spark):
    """Without a round of searching, the cells are compared by brute force."""
    rng = np.random.default_rng(7)
    x = clustered(rng, [1] * 20 + [4] * 5, 0.05)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)], SCHEMA)
    assert sum(r.n_links for r in vectors.near_duplicates(df, rounds=0).collect()) == 5 * 4 * 3
