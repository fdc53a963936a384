"""Vector best-fit packing of documents into training sequences.

A sequence is a bin with three capacities: tokens, documents, and attention cost (the squared length of each piece, as
pieces don't attend to each other). Pieces are placed from the longest to the shortest; each goes into a bin where all
three still fit, chosen among the open ones by the weighted norm of the residual it would leave (least first) or by the weighted
dot product of its sizes with the residual (largest first).

A piece's sizes follow from its length, so the bins are chosen for the counts of pieces by length and not for single
pieces: equal bins are one range of sequence numbers, a step fills as many of them as there are pieces, and gives what one
piece after the other would get. The plan has a few entries a length at any size of the corpus. Pieces
find their entry by their rank among those of their length."""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.bpe import byte_symbols
from webloom.llm.common import columns_without, quoted, written
from webloom.session import ship_package

#: The word pattern of byte-level tokenizer files that say ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts encoded at once; an Arrow slice of pieces is given out after each.
TEXTS = 64


class ByteBpe:
    """The byte-level vocabulary of a tokenizer file. Where its merges are in the order of their ids, which makes
    a vocabulary string's id its rank, words are merged by tiktoken, else by the tokenizers library: the ids are the same."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"]
        self.plain = Tokenizer.from_str(source)
        self.plain.no_padding()
        self.plain.no_truncation()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = None
        bytes_of = {c: b for b, c in enumerate(byte_symbols())}
        own = {s: i for s, i in model["vocab"].items() if s not in self.added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = sorted(own, key=own.get)[256:] == ["".join(m) for m in pairs] and sorted(own.values()) == list(range(len(own)))
        simple = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if (in_order and simple and model["type"] == "BPE" and not model.get("ignore_merges") and spec["normalizer"] is None
                and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]):
            import tiktoken
            ranks = {bytes(bytes_of[c] for c in s): i for s, i in own.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str) -> np.ndarray:
        """Ids as ``uint32``; special tokens spelled in the text become their ids."""
        if self.fast is not None:
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict[int, ByteBpe] = {}


def _loaded(source: str) -> ByteBpe:
    if (key := hash(source)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(source)
    return _LOADED[key]


def longest_piece(tokens: int, cost: int | None) -> int:
    return tokens if cost is None else min(tokens, math.isqrt(cost))


def pieces(df: DataFrame, path: str, text: str = "text", longest: int = 2048, end: int = 0) -> DataFrame:
    """The token sequence of every row (ids of its text, then ``end``) cut from the back into pieces of ``longest`` tokens;
    the first holds what is left. Adds ``piece, start, length, ids_crc32`` to the columns of ``df`` but the text, and the
    place ``part, nth`` of a piece among those of its length: the task that made it and its number there.

    A null text is empty, so every row has a piece. The vocabulary file is broadcast: its size is fixed (1 to 2 MB)."""
    ship_package(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    made = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    types = [T.IntegerType(), T.LongType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.LongType()]
    kept = columns_without(df, (text, "sequence_id", "offset", "__base", "__rank", *(n for n, _ in made)))
    src = df.select(*[quoted(c) for c in kept], quoted(text).alias("__text"))
    out = T.StructType([src.schema[c] for c in kept] + [T.StructField(n, t) for (n, _), t in zip(made, types, strict=True)])

    def run(batches):
        from pyspark import TaskContext
        bpe, part_id, seen = _loaded(shared.value), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        last = np.array([end], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                row, rows = [], []
                for r, t in enumerate(part.column(part.num_columns - 1)):
                    ids = np.concatenate([bpe.encode(t.as_py() or ""), last])
                    head = len(ids) % longest or longest
                    for k, start in enumerate([0, *range(head, len(ids), longest)]):
                        cut = ids[start:head if k == 0 else start + longest]
                        row.append(r)
                        rows.append((k, start, len(cut), zlib.crc32(cut.tobytes()), part_id, int(seen[len(cut)])))
                        seen[len(cut)] += 1
                taken = part.take(pa.array(row, pa.int64()))
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), made, strict=True)]
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], *cols], names=out.names)
    return src.mapInArrow(run, out)


@dataclass
class Bins:
    """Open bins ``first .. first + n - 1`` that hold the same pieces."""
    tokens: int
    docs: int
    cost: int
    first: int
    n: int


@dataclass(frozen=True)
class Entry:
    """Pieces of ``length`` and ranks ``rank .. rank + n * each - 1`` go ``each`` at a time into bins from ``first`` on, at ``offset``."""
    length: int
    rank: int
    n: int
    each: int
    first: int
    offset: int


def plan(counts: dict[int, int], tokens: int, docs: int | None = None, cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> list[Entry]:
    """Vector best fit of ``counts`` pieces by length, longest first. A missing capacity never binds.

    ``norm``: the feasible bin of least ``sum w * (residual - size) ** 2`` (sizes as shares of capacities; ties: the
    earlier bin). A bin that takes a piece stays the best while the piece fits, so it is filled at once. ``dot``: the
    feasible bin of largest ``sum w * residual * size``; a bin that takes a piece falls behind its equals, so each takes one.
    A new bin is opened only when no open one has room in every capacity."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    docs = tokens if docs is None else docs
    cost = tokens * tokens if cost is None else cost
    if tokens < 1 or docs < 1 or cost < 1:
        raise ValueError("capacities must be at least 1")
    caps = (float(tokens), float(docs), float(cost))

    def score(b: Bins, size: tuple[int, int, int]) -> float:
        left = (b.tokens, b.docs, b.cost)
        if rule == "norm":
            return sum(w * ((r - s) / c) ** 2 for w, r, s, c in zip(weights, left, size, caps, strict=True))
        return -sum(w * (r / c) * (s / c) for w, r, s, c in zip(weights, left, size, caps, strict=True))

    open_bins: list[Bins] = []
    entries, used = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        size = (length, 1, length * length)
        if length > tokens or size[2] > cost:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, rank = counts[length], 0
        while left:
            fitting = [b for b in open_bins if b.tokens >= length and b.docs >= 1 and b.cost >= size[2]]
            if fitting:
                best = min(fitting, key=lambda b: (score(b, size), b.first))
                open_bins.remove(best)
            else:
                each = min(tokens // length, docs, cost // size[2]) if rule == "norm" else 1
                best = Bins(tokens, docs, cost, used, -(-left // each) if rule == "norm" else 1)
                used += best.n
            each = min(best.tokens // length, best.docs, best.cost // size[2]) if rule == "norm" else 1
            full = min(best.n, left // each)
            takes = [(full, each)] if full else []
            if full < best.n and (rest := min(left - full * each, each)):
                takes.append((1, rest))
            at = best.first
            for n, k in takes:
                entries.append(Entry(length, rank, n, k, at, tokens - best.tokens))
                open_bins.append(Bins(best.tokens - k * length, best.docs - k, best.cost - k * size[2], at, n))
                at, rank, left = at + n, rank + n * k, left - n * k
            if best.first + best.n > at:
                open_bins.append(Bins(best.tokens, best.docs, best.cost, at, best.first + best.n - at))
        open_bins = [b for b in open_bins if b.tokens and b.docs and b.cost]
    return entries


def place(cut: DataFrame, counts: DataFrame, entries: list[Entry]) -> DataFrame:
    """``sequence_id, offset`` for every row of :func:`pieces` (``part`` and ``nth`` go). A piece's rank is its number in its task
    plus the pieces of its length in the tasks before; ``counts`` holds ``length, part, n``."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("__rank", F.col("nth") + F.col("__base")).drop("part", "nth", "__base")
    kept = [c for c in ranked.columns if c not in ("__rank", "length")]
    src = ranked.select(*[quoted(c) for c in kept], "length", "__rank")
    out = T.StructType([src.schema[c] for c in kept] + [src.schema["length"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.IntegerType())])
    order = sorted(entries, key=lambda e: (e.length, e.rank))
    table = np.array([(e.length, e.rank, e.each, e.first, e.offset) for e in order], np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        lengths, firsts = np.unique(table[:, 0], return_index=True)
        ends = np.append(firsts[1:], len(table))
        for batch in batches:
            length = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine = length == value
                k = np.searchsorted(lengths, value)
                ranks = table[firsts[k]:ends[k], 1]
                at[mine] = firsts[k] + np.searchsorted(ranks, rank[mine], side="right") - 1
            _, start, each, first, offset = table[at].T
            bin_, inside = np.divmod(rank - start, each)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first + bin_, pa.int64()), pa.array(offset + inside * length, pa.int32())], names=out.names)
    return src.mapInArrow(run, out)


def pack(df: DataFrame, path: str, text: str = "text", tokens: int = 2048, docs: int | None = None, cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", end: int = 0) -> DataFrame:
    """One row a piece: the columns of ``df`` but ``text``, then ``piece, start, ids_crc32, length, sequence_id, offset``
    (input columns of these names, ``part`` and ``nth`` are dropped). Sequences hold at most ``tokens`` tokens, ``docs``
    pieces and ``cost`` squared length; offsets have no gap.

    Only documents longer than a sequence (or whose attention cost alone is beyond ``cost``) are cut. Nulls: a null text
    is an empty one and gets one piece with the end token; a null in any other column is kept as it is. Repeated rows and
    ids are packed each. Very long texts are encoded whole. An empty table gives no rows.

    Texts are read once; only pieces without text are shuffled, by length and task, and no key of that join holds more
    than one task's pieces. The driver sees one count a length, at most ``tokens`` of them, and plans on these."""
    cut = written(pieces(df, path, text, longest_piece(tokens, cost), end), "pieces")
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    return place(cut, counts, plan(by_length, tokens, docs, cost, weights, rule))
