"""Poisson replication: the inverse, rates, expected shares, defined cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from webloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string"


def brute_count(key, rate, seed=42):
    parts, total = max(math.ceil(rate / mixing.MAX_MEAN), 1), 0
    for part in range(1, parts + 1) if rate > 0 else ():
        u = int(hashlib.md5(f"{seed}:{part}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
        mean, k = rate / parts, 0
        term = cdf = math.exp(-mean)
        while cdf <= u and k < mixing.TERMS:
            k += 1
            term *= mean / k
            cdf += term
        total += k
    return total


@pytest.mark.parametrize("rate", [0.0, 0.05, 1.0, 3.7, 16.0, 100.0])
def test_counts_against_brute_force(spark, rate):
    df = spark.range(2000).withColumn("n", mixing.replication_count(F.lit(rate), [F.col("id").cast("string")], 42))
    rows = df.collect()
    assert [r.n for r in rows] == [brute_count(r.id, rate) for r in rows]
    mean = sum(r.n for r in rows) / 2000
    assert abs(mean - rate) <= 4 * math.sqrt(rate / 2000) + 1e-12


def test_shares_and_shuffle(spark):
    docs = spark.createDataFrame([(i, "t", "hot" if i % 3 else "cold", "x") for i in range(6000)], SCHEMA)
    rates = mixing.source_rates(docs, "source", {"hot": 1, "cold": 3}, total=8000)
    out = mixing.mix(docs, rates)
    assert out.columns == ["doc_id", "text", "source", "copy", "copies", "mix_key"]
    rows = out.collect()
    n = {s: sum(r.source == s for r in rows) for s in ("hot", "cold")}
    assert abs(n["hot"] - 2000) < 200 and abs(n["cold"] - 6000) < 350
    copies = {}
    for r in rows:
        copies.setdefault(r.doc_id, []).append((r["copy"], r.copies))
    assert all(sorted(c for c, _ in v) == list(range(1, v[0][1] + 1)) for v in copies.values())
    sources = [r.source for r in rows]
    runs = 1 + sum(a != b for a, b in zip(sources, sources[1:]))
    assert runs > 0.6 * 2 * n["hot"] * n["cold"] / len(rows)  # as mixed as independent draws
    assert [tuple(r) for r in mixing.mix(docs, rates).orderBy("mix_key").collect()] == [tuple(r) for r in out.orderBy("mix_key").collect()]


def test_default_rates_follow_the_square_root(spark):
    docs = spark.createDataFrame([(i, None, None if i < 100 else "a" if i < 500 else "b", None) for i in range(1400)], SCHEMA)
    got = {r.source_key: r.rate * r.n_docs for r in mixing.source_rates(docs, "source").collect()}
    assert got == pytest.approx({None: 1400 * 10 / 60, "a": 1400 * 20 / 60, "b": 1400 * 30 / 60})


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a" * 100_000, "s", None), (1, "a", "s", None), (None, None, None, None), (2, "", "t", None)], SCHEMA)
    out = mixing.mix(docs, mixing.source_rates(docs, "source", {"s": 1}, total=40)).collect()
    assert {r.source for r in out} == {"s"} and len({(r.doc_id, r["copies"]) for r in out}) == 1  # one key, one count; others have no rate
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.source_rates(empty, "source")).count() == 0
    for bad in ({"s": -1.0}, {"s": 0.0}):
        with pytest.raises(ValueError):
            mixing.source_rates(docs, "source", bad)
