"""SimHash against brute force over all pairs, block splitting, defined cases."""

import random

import numpy as np
import pytest
import xxhash

from webloom.llm import simhash
from webloom.llm.components import connected_components
from webloom.llm.queries import QUERIES


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[i + 1:]:
            if (a ^ b).bit_count() <= most:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vs}


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["Ab", "é", "Ünd", " ", "\n", "\x0b", "the ", "of ", "\x1c", " "], k=rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode(), 4) == brute_fingerprint(text)
    assert simhash.fingerprint(b"a b c", 4) == simhash.fingerprint(b" A  b\tC ", 4)


def test_error_patterns_are_the_covering_code():
    patterns = simhash.error_patterns(2)
    assert sorted(map(len, patterns)) == [2, *[17] * 31] and len(simhash.error_patterns(1)[0]) == 2
    assert all(simhash.error_patterns(1)[s] for s in range(32))  # covering radius 1


@pytest.mark.parametrize("most", [0, 1, 3, 4, 5, 7])
@pytest.mark.parametrize("block", [2048, 5])
def test_links_against_brute_force(spark, monkeypatch, most, block):
    if block == 5 and most not in (3, 4):
        pytest.skip("blocks are tested at two thresholds")
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(most)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 1))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    parts = {r.node: r.component for r in connected_components(simhash.fingerprint_links(fps, most)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(parts.get(signed(v), signed(v)), set()).add(v)
    want = {}
    for v, root in brute_components(values, most).items():
        want.setdefault(root, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_query_against_brute_force(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    fp = {d: brute_fingerprint(t or "") for d, t in docs}
    roots = brute_components(set(fp.values()), 4)
    first = {}
    for d, f in fp.items():
        first[roots[f]] = min(d, first.get(roots[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()}
    assert got == {d: (f"{f:016x}", first[roots[f]]) for d, f in fp.items()}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x y z w v"), (4, "x y z w v"), (None, "X y z w v"), (5, "w " * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp long, component long")
    got = simhash.near_duplicates(df, ["doc_id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(lambda x: sorted(x, key=str), by.values()), key=str) == [[1, 2, 3], [4, 4, None], [5]]
    assert simhash.near_duplicates(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, 8)


def test_components_of_a_long_path(spark):
    n = 60
    links = spark.createDataFrame([(int(i), int(i + 1)) for i in np.random.default_rng(0).permutation(n)] + [(100, 100)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)}
