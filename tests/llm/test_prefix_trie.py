"""Prefix trie against brute force: shared heads, copies over many shards, spilling, defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def words(text):
        return len([w for w in text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * words(node[-1][1]) if node else 0)
    return {(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, m in members.items()}


def built(spark, rows, heads=True):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    convs = P.conversations(frame)
    if heads:
        convs = P.rebuilt(convs, F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    got = P.trie(convs)
    assert got.columns == NAMES and all(t == "bigint" for n, t in got.dtypes if n != "ends_sha256")
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def random_rows(rng, n):
    rows = []
    for c in rng.sample(range(-60, 4 * n), n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a b", "a b\t c", "", "ä\x0bö é x"])))
    return rows


@pytest.mark.parametrize("heads", [False, True])
def test_against_brute_force(spark, heads):
    rows = random_rows(random.Random(3), 120)
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(150) for t in range(5)]  # copies, and a common first turn
    rows += [(2000 + i, t, "user", f"same {t}" if t == 0 else f"own {i} {t}") for i in range(60) for t in range(3)]
    convs = sequences(rows)
    assert built(spark, rows, heads) == brute(with_heads(convs) if heads else convs)


def test_copies_over_all_shards_and_ends_in_parts(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shards
    try:
        rows = [(i, t, "user", "hello there") for i in range(300) for t in range(i % 3 and 2)]
        rows += [(i, 0, None, None) for i in range(300, 310)]
        assert built(spark, rows, False) == brute(sequences(rows))
        long = [(i, t, "u", f"deep {t}") for i in range(40) for t in range(60 + i % 2)]
        assert built(spark, long, False) == brute(sequences(long))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_shard_in_parts(monkeypatch):
    """A run of ends longer than one row, inside a shard."""
    monkeypatch.setattr(P, "ENDS", 3)

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 7
    import pyspark
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    a, b, c = (bytes([k]) * P.DIGEST for k in (1, 2, 3))
    rows = [(a, 1), (b, 10), (b, 11), (b, 12), (b, 13), (b, 14), (b, 15), (b + c, 5), (c, 2)]
    out = list(P.shard_nodes((conv, path, [1] * (len(path) // P.DIGEST)) for path, conv in rows))
    parts = [r[10] for r in out if r[11] == 1 and r[7] == P._keys(b)[1]]
    assert parts == ["10,11,12", "13,14,15"]
    node = next(r for r in out if r[11] == 0 and r[7] == P._keys(b)[1])
    assert node[4:6] == (5, 7) and node[10] is None and not node[9]


def test_queue_spills_in_order():
    rng = random.Random(5)
    items = [(rng.randint(0, 50), rng.randint(0, 50), i) for i in range(5000)]
    queue = P.SpillingQueue(limit=64)
    got = []
    for i, item in enumerate(items):
        queue.push(item)
        if i == 2500:
            got = list(queue.pop_below((20, 0, 0)))
            assert got == sorted(x for x in items[:2501] if x < (20, 0, 0))
    rest = list(queue.pop_below((99, 0, 0)))
    assert queue.spilled > 30 and rest == sorted(set(items) - set(got)) and not queue.runs


def test_totals_with_a_small_queue(monkeypatch):
    monkeypatch.setattr(P, "QUEUE", 8)
    # a complete binary tree of depth 9, ids by level
    nodes = [(0, d, i, i // 2 if d else None, 0, 1, 0, False) for d in range(9, -1, -1) for i in range(2 ** d)]
    out = dict(zip([(n[1], n[2]) for n in nodes], P.subtree_totals(iter(nodes)), strict=True))
    assert out[0, 0] == (2, 512, 1023) and out[8, 255] == (2, 2, 3) and out[9, 0] == (0, 1, 1)


def test_defined_cases(spark):
    assert built(spark, []) == set()
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "a", "x"), (5, 0, "a", "x"), (7, 1, "a", "b" * 100_000), (7, 0, "b", "x y")]
    assert built(spark, rows, False) == brute(sequences(rows))
    # every turn replaced by a base that is absent: a turnless conversation ends at the root
    turnless = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(turnless, 0, "user", "gone")]
    assert built(spark, rows) == brute({turnless: []}) == {(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
