"""Language model: exact counts and base, gradients, normalisation, carried state, held-out gain, defined cases."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import lm
from webloom.llm.queries import QUERIES


def small_head(n=1200):
    rng = np.random.default_rng(0)
    words = [b"", *(f"w{i}".encode() for i in range(n))]
    return lm.Head(lm._Numbers((w, i) for i, w in enumerate(words)), np.sort(rng.integers(3, 1000, n + 1))[::-1].astype(float), 10 ** 6, n + 100,
                   np.arange(8.0), np.arange(8.0))


def test_gradients_against_differences():
    head = small_head()
    net = lm.Network.fresh(head)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    flat, lengths = rng.integers(-8, len(head.counts), 60).astype(np.int32), np.array([25, 20, 15])
    walk = lm.Lanes(flat, lengths, head, 3)
    x, cls, word, _, valid = walk.window(6)
    h = rng.standard_normal((3, lm.HIDDEN)) * 0.3

    def loss():
        states = np.empty((*x.shape, lm.HIDDEN))
        s = h
        for t in range(len(x)):  # in double precision
            g, u = net.p["G"][x[t]], s @ net.p["U"]
            k = lm.HIDDEN
            zr = 1 / (1 + np.exp(-(g[:, :2 * k] + u[:, :2 * k])))
            n = np.tanh(g[:, 2 * k:] + zr[:, k:] * u[:, 2 * k:])
            s = n + zr[:, :k] * (s - n)
            states[t] = s
        return -net.log_probability(states.reshape(-1, lm.HIDDEN), cls.ravel(), word.ravel()).mean()
    grads, _ = net.gradients(x, h, cls, word, valid)
    for name in net.p:
        at = np.unravel_index(np.argsort(-np.abs(grads[name]).ravel())[:3], grads[name].shape)
        for place in zip(*at):
            keep = net.p[name][place]
            net.p[name][place] = keep + 1e-4
            up = loss()
            net.p[name][place] = keep - 1e-4
            down = loss()
            net.p[name][place] = keep
            assert grads[name][place] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-6)


def test_output_is_a_distribution():
    head = small_head()
    net = lm.Network.fresh(head)
    rng = np.random.default_rng(2)
    net.p["C"] = rng.standard_normal(net.p["C"].shape).astype(np.float32)
    net.p["W"] = rng.standard_normal(net.p["W"].shape).astype(np.float32)
    n = len(head.counts)
    h = np.repeat(rng.standard_normal((1, lm.HIDDEN)).astype(np.float32), n, axis=0)
    word = np.where(np.arange(n) < lm.NEURAL, np.arange(n), -1)
    inside = np.exp(net.log_probability(h, head.cls, word) + head.own).sum()
    logits = net.class_logits(h[:1])[0].astype(float)
    p = np.exp(logits - logits.max())
    p /= p.sum()
    used = np.unique(head.cls)
    assert inside == pytest.approx(p[used].sum(), rel=1e-4)  # every class of head words sums to its share
    tail = [(head.tail_total[e] + 0.1 * head.tail_distinct[e] + 0.1) / (head.tail_total[e] + 0.1 * (head.tail_distinct[e] + 1)) for e in range(8)]
    assert tail == pytest.approx([1.0] * 8)


def test_state_is_carried_and_lanes_do_not_matter(monkeypatch):
    head = small_head()
    net = lm.train_copy(lm.Network.fresh(head), head, np.tile(np.arange(40, dtype=np.int32), 50), np.full(40, 50), 20, 0.02, 0)
    rng = np.random.default_rng(3)
    lengths = np.array([1, 300, 33, 32, 31, 7, 120])
    flat = rng.integers(-8, 60, lengths.sum()).astype(np.int32)
    want = lm.log_likelihoods(net, head, flat, lengths, lanes=7)
    for window, lanes in ((1000, 3), (5, 1), (32, 2)):
        monkeypatch.setattr(lm, "WINDOW", window)
        assert lm.log_likelihoods(net, head, flat, lengths, lanes) == pytest.approx(want, rel=1e-5)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_lm"](spark, sf).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    tokens = {d: lm.words_of((t or "").encode()) for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = model = told = 0
    for d, ws in tokens.items():
        r = got[d]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) and r.base_score == pytest.approx(want, rel=1e-9)
        if r.held_out:
            base, model, told = base + r.base_score, model + r.score, told + r.n_tokens
    assert model > base + 0.1 * told  # a gain of over 0.1 a token on unseen documents


def test_words_beyond_the_head(spark, monkeypatch):
    """With a head of a few words the join gives all others the same base, and the model is still a distribution."""
    docs = spark.createDataFrame([(i, f"the cat{i % 7} sat the end{i % 5}") for i in range(40)] + [(99, "the dog zebra")], "doc_id long, text string")
    run = lambda: {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 40, ["doc_id"], rounds=1, updates=5).collect()}
    whole = run()
    monkeypatch.setattr(lm, "HEAD", 3)
    cut = run()
    for d, r in whole.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (cut[d].n_tokens, cut[d].n_known, cut[d].train_tokens)
        assert r.base_score == pytest.approx(cut[d].base_score, rel=1e-9) and cut[d].score < 0
    assert whole[99].n_known == 2


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "Z " * 50_000)]
    df = spark.createDataFrame([(*r, 0.5, b"x") for r in rows], "doc_id long, text string, score double, t binary")
    out = lm.score(df, F.col("doc_id") > 0, ["doc_id"], rounds=1, updates=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted([("1", 1), ("2", 1), ("3", 1), ("None", 3), ("4", 3), ("4", 3), ("5", 50_001)])
    assert all(math.isfinite(r.score) and r.score < 0 and r.train_tokens == 50_010 for r in out)
    assert lm.score(df.limit(0), F.lit(True), ["doc_id"], rounds=1, updates=1).count() == 0
    unseen = lm.score(df, F.lit(False), ["doc_id"], rounds=1, updates=1).collect()
    assert {(r.n_known, r.train_tokens) for r in unseen} == {(0, 0)} and all(math.isfinite(r.score) for r in unseen)


def test_training_covers_every_token(monkeypatch):
    """One long document among short ones: the windows of a pass hold each token once."""
    head, told, real = small_head(), [], lm.Network.gradients

    def counted(self, x, h, cls, word, valid, *more):
        told.append((cls[valid], valid.size))
        return real(self, x, h, cls, word, valid, *more)
    monkeypatch.setattr(lm.Network, "gradients", counted)
    rng = np.random.default_rng(4)
    lengths = np.array([20_020] + [5] * 100)
    flat = rng.integers(-8, len(head.counts), lengths.sum()).astype(np.int32)
    lm.train_copy(lm.Network.fresh(head), head, flat, lengths, 10 ** 9, 0.02, 0)
    cls = np.where(flat >= 0, head.cls[np.maximum(flat, 0)], lm.TAIL_CLASS - 1 - flat)
    assert np.bincount(np.concatenate([c for c, _ in told])).tolist() == np.bincount(cls).tolist()
    assert sum(size for _, size in told) < 1.02 * lengths.sum()  # hardly any padding


def test_pieces_hold_every_row_and_their_states(spark):
    """More documents than the sample once had, and one of several pieces: all tokens, in groups that grow in number."""
    docs = spark.createDataFrame([(i, f"a b w{i}") for i in range(5000)] + [(5000, " ".join(f"w{i * i % 997}" for i in range(10_000)))], "doc_id long, text string")
    learned = docs.select(F.col("text").cast("binary").alias("t"))
    head = lm.learn_head(lm.count_words(learned))
    rows = lm.pieces(learned, head, spark.sparkContext.broadcast(head), 9).collect()
    assert sum(len(r.codes) // 2 - r.lead for r in rows) == head.total == 30_001 and {r.g for r in rows} == set(range(9))
    words = [head.number[w] for w in lm.words_of(docs.where("doc_id = 5000").first().text.encode())]
    codes = lm.codes_of(head, np.array(words))
    parts = sorted((np.frombuffer(r.codes, np.uint16)[r.lead:] for r in rows if len(r.codes) > 100), key=len)
    assert sorted(map(len, parts)) == sorted([4096, 4096, 10_001 - 8192])
    assert sorted(np.concatenate(parts).tolist()) == sorted(codes.tolist())
    net, one = lm.Network.fresh(head), np.array([len(codes)])
    net.p = {k: v * 2 for k, v in net.p.items()}
    walk = lm.Stream(codes, one, np.array([0]))
    whole = net.states(walk.inp[:, None], np.zeros((1, lm.HIDDEN), np.float32))[:, 0]
    assert np.abs(walk.warm(net)[1:] - whole[walk.at[1:] - 1]).max() < 1e-4


def test_gradients_stop_where_a_text_begins():
    head = small_head()
    net = lm.Network.fresh(head)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 90, (6, 2)).astype(np.int32)
    cls, word, all_, begins = x // lm.CLASS_WORDS, x, np.ones(x.shape, bool), np.zeros(x.shape, bool)
    begins[3] = True
    zero = np.zeros((2, lm.HIDDEN), np.float32)
    got, last = net.gradients(x, zero, cls, word, all_, begins)
    a, b = (net.gradients(x[c], zero, cls[c], word[c], all_[c]) for c in (slice(0, 3), slice(3, 6)))
    assert np.allclose(last, b[1])
    for k in got:
        assert np.allclose(got[k], (a[0][k] + b[0][k]) / 2, atol=1e-6)


def test_null_texts_and_copies_go_to_all_groups(spark):
    """A third of rows null in key and text, a third copies of one text: no group holds more than its part of either."""
    rows = [(None, None)] * 1000 + [(None, "the same text")] * 1000 + [(i, f"a b w{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("t"))
    head = lm.learn_head(lm.count_words(df))
    dealt = lm.pieces(df, head, spark.sparkContext.broadcast(head), 10).groupBy("g", F.length("codes").alias("n")).count().collect()
    assert sum(r["count"] for r in dealt) == 3000 and {r.g for r in dealt} == set(range(10))
    assert all(r["count"] < 270 for r in dealt)  # null: 1 token; copies and others: 4, 2000 rows in all
