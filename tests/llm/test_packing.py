"""Vector best fit: the plan against packing one piece after the other, ids against the public library, defined cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webloom.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, offset double, part int"


def one_by_one(counts, tokens, docs, cost, weights, rule):
    """Residuals of all bins after placing single pieces."""
    bins, caps = [], (tokens, docs, cost)
    for length in sorted(counts, reverse=True):
        size = (length, 1, length * length)
        for _ in range(counts[length]):
            fit = [k for k, b in enumerate(bins) if all(r >= s for r, s in zip(b, size, strict=True))]
            if not fit:
                bins.append(list(caps))
                k = len(bins) - 1
            elif rule == "norm":
                k = min(fit, key=lambda k: (sum(w * ((r - s) / c) ** 2 for w, r, s, c in zip(weights, bins[k], size, caps, strict=True)), k))
            else:
                k = min(fit, key=lambda k: (-sum(w * (r / c) * (s / c) for w, r, s, c in zip(weights, bins[k], size, caps, strict=True)), k))
            bins[k] = [r - s for r, s in zip(bins[k], size, strict=True)]
    return sorted(map(tuple, bins))


def bins_of(entries, counts, tokens, docs, cost):
    placed, ranks = defaultdict(list), defaultdict(list)
    for e in entries:
        ranks[e.length] += range(e.rank, e.rank + e.n * e.each if e.each else 0)
        for b in range(e.first, e.first + e.n):
            placed[b] += [(e.offset + j * e.length, e.length) for j in range(e.each)]
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items() if n}
    out = []
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        out.append((tokens - at, docs - len(spans), cost - sum(n * n for _, n in spans)))
        assert min(out[-1]) >= 0
    assert sorted(placed) == list(range(len(placed)))
    return sorted(out)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_is_vector_best_fit(rule):
    rng = random.Random(1)
    for _ in range(120):
        tokens = rng.choice([10, 16, 50])
        docs, cost = rng.choice([2, 3, tokens]), rng.choice([tokens ** 2, tokens ** 2 // 2, tokens ** 2 // 3])
        weights = rng.choice([(1, 1, 1), (1, .5, .2), (1, 0, 0)])
        counts = {n: rng.randint(0, 9) for n in range(1, P.longest_piece(tokens, cost) + 1)}
        got = bins_of(P.plan(counts, tokens, docs, cost, weights, rule), counts, tokens, docs, cost)
        assert got == one_by_one(counts, tokens, docs, cost, weights, rule)


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    lengths, n = np.unique(np.minimum(rng.lognormal(6.4, 0.9, 200_000).astype(int) + 1, 2048), return_counts=True)
    counts = {int(a): int(b) for a, b in zip(lengths, n, strict=True)}
    small, large = P.plan(counts, 2048), P.plan({a: b * 10_000 for a, b in counts.items()}, 2048)
    assert len(large) < 3 * len(small) < 20_000
    used = max(e.first + e.n for e in large)
    assert used < 1.002 * sum(a * b for a, b in counts.items()) * 10_000 / 2048


def test_plan_refuses():
    for call in (lambda: P.plan({11: 1}, 10), lambda: P.plan({1: 1}, 0), lambda: P.plan({1: 1}, 5, rule="x"), lambda: P.plan({3: 1}, 5, cost=8)):
        with pytest.raises(ValueError):
            call()
    assert P.plan({}, 10) == []


def test_ids_equal_the_library():
    bpe, lib = P.ByteBpe(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    assert bpe.fast is not None
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoftext|>", "a" * 50_000, " " * 50_000, "\n \t" * 2000 + "x", "'S's'LL don't"]
    texts += ["".join(chr(c) + rng.choice(["", " ", "a", "1", "\n"]) for c in range(a, a + 512) if not 0xD800 <= c <= 0xDFFF) for a in range(0, 0x30000, 512)]
    for t in texts:
        assert bpe.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def packed(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1.0, 3) for i, t in rows], SCHEMA)
    return P.pack(df, PATH, "text", **kw).collect()


def hold(rows, got, tokens, docs=None, cost=None):
    """Every document whole and cut as stated, every sequence gapless and within its capacities; number of sequences."""
    lib, longest = Tokenizer.from_file(PATH), P.longest_piece(tokens, cost)
    want = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % longest or longest
        cuts = [ids[:head], *(ids[a:a + longest] for a in range(head, len(ids), longest))]
        at = 0
        for k, c in enumerate(cuts):
            want.append((i, k, at, len(c), zlib.crc32(np.array(c, "<u4").tobytes())))
            at += len(c)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= tokens and len(spans) <= (docs or at) and sum(n * n for _, n in spans) <= (cost or at * at)
    return len(bins)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "né", "42"]) for _ in range(rng.choice([0, 1, 7, 30, 90, 400])))) for i in range(400)]
    rows += [(1000 + i, "same text here") for i in range(300)]
    got = packed(spark, rows, tokens=128)
    n = hold(rows, got, 128)
    assert n <= 1.02 * sum(r.length for r in got) / 128 + 1
    got = packed(spark, rows, tokens=128, docs=3, cost=8000, weights=(1, .5, .5))
    assert hold(rows, got, 128, 3, 8000) >= len(got) / 3
    got = packed(spark, rows, tokens=128, docs=5, rule="dot")
    hold(rows, got, 128, 5)


def test_defined_cases(spark):
    assert packed(spark, []) == []
    rows = [(None, None), (1, ""), (1, ""), (None, "x"), (2, "word " * 20_000), (3, "<|endoftext|>")]
    got = packed(spark, rows)
    hold(rows, got, 2048)
    assert set(got[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
