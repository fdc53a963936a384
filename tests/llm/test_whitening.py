"""Whitening against exact covariances in fractions, wide values, defined cases."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import whitening as W

SCHEMA = "vec_id long, v array<float>, x string, whitened int, deviation string"


def prepared(spark, rows):
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA)
    return W.prepared(df.withColumn("q", W.quantised(F.col("v"))), "q")


def exact_covariance(vectors):
    once = [list(v) for v in {tuple(v) for v in vectors}]
    n, d = len(once), len(once[0])
    mean = [Fraction(sum(v[i] for v in once), n) for i in range(d)]
    return n, mean, [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in once) / n for j in range(d)] for i in range(d)]


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # copies count once
    df = prepared(spark, rows)
    model = W.fit(df, "q", components=5)
    q = {r.vec_id: r.q for r in df.select("vec_id", "q").collect()}
    n, mean, cov = exact_covariance(q.values())
    assert model.n == n == 150
    assert [[Fraction(v, n ** 3) for v in row] for row in model.numerators] == cov
    values = np.linalg.eigvalsh(np.array(cov, float))[::-1]
    np.testing.assert_allclose(model.values, values[:5], rtol=1e-9)
    assert abs(model.trace - float(sum(cov[i][i] for i in range(12)))) < 1e-6 and model.identity_error < 1e-9
    out = {r.vec_id: r for r in W.whiten(df, model, "q").collect()}
    assert set(out) == set(q)
    for i, r in out.items():
        assert int(r.deviation) == sum((n * x - int(n * m)) ** 2 for x, m in zip(q[i], mean, strict=True))
        want = model.vectors @ np.array([float(x - m) for x, m in zip(q[i], mean, strict=True)]) / np.sqrt(model.values)
        np.testing.assert_allclose(r.whitened, want, atol=1e-9)
    once = np.array([out[i].whitened for i in range(150)])
    np.testing.assert_allclose(np.cov(once.T, bias=True), np.eye(5), atol=1e-9)


def test_squares_of_wide_values_are_exact():
    rng = random.Random(2)
    values = [[rng.randint(-2 ** 62 + 1, 2 ** 62 - 1) >> rng.randint(0, 61) for _ in range(3)] for _ in range(200)]
    assert W._square_sums(np.array(values)) == [sum(v[k] ** 2 for v in values) for k in range(3)]


def test_wide_vectors(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.randint(-10 ** 15, 10 ** 15), rng.randint(0, 9)]) for i in range(40)], "vec_id long, q array<long>")
    model = W.fit(df, "q")
    _, _, cov = exact_covariance([r.q for r in df.collect()])
    assert [[Fraction(v, 40 ** 3) for v in row] for row in model.numerators] == cov
    with pytest.raises(ValueError):
        W.fit(spark.createDataFrame([(0, [2 ** 62]), (1, [-(2 ** 62)]), (2, [0])], "vec_id long, q array<long>"), "q")


def test_quantised(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("-inf"), 0.0]), (5, None), (6, [])],
                               "id long, v array<float>")
    got = {r.id: r.q for r in df.select("id", W.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [1_000_032, 999_999], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_defined_cases(spark):
    for rows, n, k in [([], 0, 0), ([(1, None)], 0, 0), ([(1, [])], 1, 0), ([(1, [0.5, 0.5]), (2, [0.5, 0.5])], 1, 0),
                       ([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (None, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0])], 3, 1)]:
        df = prepared(spark, rows)
        model = W.fit(df, "q")
        out = W.whiten(df, model, "q").collect()
        assert (model.n, len(model.values)) == (n, k) and all(len(r.whitened) == k for r in out)
        assert len(out) == sum(v is not None and len(v) == (2 if n > 1 or k else len(v)) and not any(c != c for c in v) for _, v in rows)
        assert [c for c in W.whiten(df, model, "q").columns] == ["vec_id", "v", "x", "q", "deviation", "whitened"]
