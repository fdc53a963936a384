"""Exact top-k against brute force, ties, wide integers, pruning, defined cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webloom.llm import topk

SCHEMA = "vec_id long, vector array<long>, score long, rank int"


def brute(docs, queries, k):
    out = set()
    for qid, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, d)), did) for did, d in docs if did != qid)
        out |= {(qid, i, did, -s) for i, (s, did) in enumerate(scored[:k], 1)}
    return out


def brute_rows(docs, asking, k):
    """By row number: a query is a row, its candidates all other rows."""
    out = []
    for a in asking:
        scored = sorted((-sum(x * y for x, y in zip(docs[a][1], v)), i) for n, (i, v) in enumerate(docs) if n != a)
        out += [(docs[a][0], place, i, -s) for place, (s, i) in enumerate(scored[:k], 1)]
    return out


def run(spark, docs, queries, k):
    frame = lambda rows: spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    return {tuple(r) for r in topk.exact_topk(frame(docs), frame(queries), k).collect()}


def test_against_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "PACK", 16)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = random.Random(1)
    docs = [(i, [rng.randint(-2, 2) for _ in range(5)]) for i in range(150)]
    assert run(spark, docs, docs[::9], 5) == brute(docs, docs[::9], 5)
    assert run(spark, docs[:3], docs[:3], 5) == brute(docs[:3], docs[:3], 5)


def test_wide_integers_are_exact(spark):
    docs = [(i, [2 ** 30 + i, -(2 ** 29) + 3 * i]) for i in range(30)]
    assert run(spark, docs, docs[:4], 3) == brute(docs, docs[:4], 3)


def test_blocks_below_the_kth_score_are_skipped():
    chunk = topk.Chunk(np.array([0]), np.array([0]), np.array([[1, 0]]), 2)
    docs = np.array([[100 - i, 7] for i in range(10 * topk.BLOCK)])
    chunk.meet(np.arange(1, len(docs) + 1), np.ones(len(docs), np.int64), docs)
    assert chunk.scored == 1 and list(chunk.score) == [100, 99]


def test_quantised(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001, 1.0]), (2, [None, 1.0, 1.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]),
                                (5, None), (6, [])], "id long, v array<float>")
    got = {r.id: r.q for r in df.select("id", topk.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [128, -1, 256], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_defined_cases(spark):
    rows = [(0, [1, 2]), (0, [1, 1]), (1, [3]), (None, [9, 9]), (2, None), (3, []), (4, [1, 1])]
    got = run(spark, rows, [(0, [1, 2]), (0, [1, 1]), (None, [1]), (7, None)], 9)
    # both rows of id 0 ask, and each is a candidate of the other
    assert got == set(brute_rows([(0, [1, 2]), (0, [1, 1]), (1, [3, 0]), (3, [0, 0]), (4, [1, 1])], [0, 1], 9))
    assert run(spark, [], [], 5) == set() and run(spark, rows, [], 5) == set() and run(spark, [], rows[:1], 5) == set()


def test_repeated_ids_and_rows_are_candidates_and_queries_each(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "PACK", 8)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = random.Random(5)
    docs = [(rng.choice([0, 0, 0, 1, 2, 7]), [rng.randint(-1, 1) for _ in range(3)]) for _ in range(90)]
    frame = lambda rows: spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    asking = [n for n in range(90) if docs[n][0] in (0, 7)]
    got = [tuple(r) for r in topk.exact_topk(frame(docs), frame([docs[n] for n in asking]), 5).collect()]
    assert sorted(got) == sorted(brute_rows(docs, asking, 5))
    padded = [(0, [1, 0]), (0, [1]), (0, [2, 0, 0])]
    assert sorted(tuple(r) for r in topk.exact_topk(frame(padded), frame(padded), 5).collect()) == sorted(brute_rows([(0, [1]), (0, [1]), (0, [2])], [0, 1, 2], 5))


def test_nothing_is_joined_or_broadcast_however_many_queries_ask(spark):
    rows = spark.range(3000).select("id", F.array(F.col("id") % 91, F.col("id") % 7).alias("v"))
    docs = rows.toDF("vec_id", "vector")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = topk.exact_topk(docs, docs, 2)
        assert found.count() == 6000
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # copies of the queries for all parts were broadcast where the table of queries was small
    assert "Join" not in plan and "Broadcast" not in plan


def test_vectors_are_no_part_of_the_keys_sampled_for_the_driver(spark, monkeypatch):
    plans, written = [], topk.written
    monkeypatch.setattr(topk, "written", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or written(df, *a))
    rows = [(i, [i, 1]) for i in range(9)]
    assert run(spark, rows, rows, 2) == brute(rows, rows, 2)
    dealt = [line for plan in plans for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert dealt and not any(" v#" in line or "[v#" in line for line in dealt)


def test_every_part_meets_every_group(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, [rng.randint(-300, 300) for _ in range(rng.randint(0, 6))]) for i in range(130)]
    padded = [(i, v + [0] * (6 - len(v))) for i, v in docs]
    for held, worth in ((5, 10 ** 10), (130, 1), (20, 500)):
        for name, value in (("PACK", 4), ("CHUNK", 3), ("HELD", held), ("WORTH", worth)):
            monkeypatch.setattr(topk, name, value)
        assert run(spark, docs, docs[::4], 4) == brute(padded, padded[::4], 4)
        assert run(spark, docs[:3], docs, 4) == brute(padded[:3], padded, 4)


def test_grid_holds_all_documents_and_copies_little():
    assert topk._grid(0, 0, 0, 0, 5, 200) == topk._grid(9, 9, 1, 1, 0, 200) == (1, 1)
    assert topk._grid(1000, 64000, 1, 64, 100, 200) == (1, 1)
    for docs, asked in ((600_000, 12_000), (15_000_000, 300_000), (10 ** 6, 10 ** 6), (2000, 10 ** 8), (10 ** 8, 3000)):
        packs = -(-docs // topk.PACK)
        parts, groups = topk._grid(docs, 128 * docs, packs, 64, asked, 600)
        assert parts <= packs and docs <= 2 * parts * topk.HELD and 128 * docs <= 2 * parts * topk.HELD_BYTES and groups <= -(-asked // topk.CHUNK)
        held = -(-docs // topk.HELD)
        assert parts * groups <= 2 * max(600, held)
        # no more rows move than with the best grid of as many tasks, but for rounding
        assert groups * docs + parts * asked <= 2 * min(g * docs + max(held, parts * groups / g) * asked for g in range(1, parts * groups + 1))


def test_a_task_without_documents_holds_no_queries():
    row = lambda task, asks, v: (task, asks, 1, 1, np.int64(7).tobytes(), np.int8(1).tobytes(), np.int8(2).tobytes(), np.int8(v).tobytes())
    names = ["task", "asks", "n", "dims", "ids", "marks", "times", "vectors"]
    rows = [row(0, 1, 3), row(1, 0, 4), row(1, 1, 3), row(2, 0, 4), row(3, 1, 3), row(3, 1, 4)]
    got = [b.to_pylist() for b in topk._search(2)([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])])]
    assert got == [[{"number": 1, "query_id": 7, "times": 2, "doc_id": 7, "score": 12}]]


def searched(docs, queries, k, width=np.int64):
    """By Chunk alone: documents are rows of (id, vector), their numbers are their places."""
    nth, seen = [], {}
    for i, v in docs:
        seen[i, tuple(v)] = seen.get((i, tuple(v)), 0) + 1
        nth.append(seen[i, tuple(v)])
    matrix = lambda rows: np.array([v for _, v in rows], width)
    part = topk.Part(np.array([i for i, _ in docs]), np.array(nth), matrix(docs))
    chunk = topk.Chunk(np.array([i for i, _ in queries]), np.arange(len(queries)), matrix(queries), k)
    chunk.search(part)
    got = [(int(r), int(d), int(s)) for r, d, s in zip(chunk.row, chunk.doc, chunk.score, strict=True)]
    want = []
    for n, (i, q) in enumerate(queries):
        other = [(-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), d) for (d, v), c in zip(docs, nth, strict=True) if (d, tuple(v), c) != (i, tuple(q), 1)]
        want += [(n, d, -s) for s, d in sorted(other)[:k]]
    assert got == want
    return chunk, part


def test_search_equals_brute_force_in_every_type(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "TILE", 3)
    for size, kind in ((3, np.float32), (2 ** 20, np.float64), (2 ** 31, object)):
        for n, dims, k in ((1, 3, 2), (30, 2, 5), (300, 6, 1), (300, 6, 7), (1001, 1, 3)):
            docs = [(rng.randint(0, n), [rng.randint(-size, size) for _ in range(dims)]) for _ in range(n)]
            chunk, part = searched(docs, docs[::3] + [(-1, [0] * dims), (-2, [size] * dims)], k)
            assert chunk._kind(part) == kind


def test_sums_past_the_exact_range_take_a_wider_type():
    # 2**24 + 1 and 2**53 + 1 are no floats of 24 and 53 bits
    for x, kind in ((2 ** 12, np.float64), (2 ** 26, object)):
        docs = [(1, [x, 0]), (2, [x, 1]), (3, [x, 0])]
        chunk, part = searched(docs, [(9, [x * (1 + (kind is object)), 1])], 2)
        assert chunk._kind(part) == kind and list(chunk.doc) == [2, 1]


def test_blocks_out_of_reach_are_left_out_and_the_rest_scored():
    rng = np.random.default_rng(4)
    heads = np.repeat(np.arange(200), topk.BLOCK) % 50  # a block's documents weigh one term
    docs = np.zeros((len(heads), 50), np.int64)
    docs[np.arange(len(heads)), heads] = rng.integers(1, 1000, len(heads))
    docs[:, 0] += rng.integers(0, 3, len(heads))
    queries = [(-1 - i, docs[i * 37]) for i in range(40)]
    chunk, part = searched(list(enumerate(docs)), queries, 5, np.int16)
    assert chunk.scored < 0.2 * 40 * len(part.highest) and chunk.skipped > 0.8 * 40 * len(part.highest)
