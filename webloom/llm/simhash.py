"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Two fingerprints link at
``max_bits`` or fewer differing bits. To find the links without comparing all pairs, anchors are the codewords of a
covering code and a fingerprint is replicated to every anchor near it; fingerprints are compared per anchor.

The code. Of the two 32-bit halves of a linked pair, one differs in t = max_bits // 2 bits at most, so each half is
covered by itself. Its anchors are the [31,26] Hamming code with the 32nd bit free: 2**27 codewords with covering
radius 1. A pair within t has a point between, within ceil(t/2) of both, and that point has an anchor within the
covering radius; so both are replicated to every anchor within covering radius plus ceil(t/2), and meet there.
That is the covering argument with the threshold shared by the two sides: no pair is lost, and for 4 bits each half
is replicated 16.5 times on average (radius 2) where the one-sided radius of 3 would take 169."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.common import let
from webloom.llm.common import map_values, written
from webloom.llm.components import connected_components

#: Fingerprints of one anchor that are compared in one task; more are dealt to blocks, and every pair of blocks meets.
BLOCK = 2048
#: Shingle hashes whose bits are counted at once (float32 sums of so many are exact).
CHUNK = 1 << 16
_digest = xxhash.xxh64_intdigest


def fingerprint(text: bytes, shingle: int) -> int:
    """Of a UTF-8 text, as an unsigned number; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    # zip over the list shifted by one word each; fewer words than a shingle are one shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((_digest(x, 42) for x in shingles), np.uint64, n)
    counts = np.zeros(64)
    for at in range(0, n, CHUNK):
        octets = hashes[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.ones(len(octets), np.float32) @ np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fp long`` (the fingerprint's 64 bits) to every row of ``df``. A null text counts as empty: 0."""
    out = T.StructType([T.StructField("fp", T.LongType(), False)])

    def start():
        def signed(t):
            x = fingerprint(t or b"", shingle)
            return x - (1 << 64) if x >> 63 else x
        return lambda texts: [[signed(t) for t in texts]]
    return map_values(df, F.col(f"`{text}`").cast("binary"), out, start, df.columns if keep is None else keep)


def error_patterns(radius: int) -> list[list[int]]:
    """By syndrome of the Hamming code: the 32-bit patterns of weight up to ``radius`` with that syndrome. Added to a
    point of that syndrome they give exactly the codewords within ``radius``. Bit i < 31 has the syndrome i + 1."""
    patterns: list[list[int]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for bits in itertools.combinations(range(32), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= i + 1 if i < 31 else 0
            patterns[syndrome].append(sum(1 << i for i in bits))
    return patterns


def syndrome(half: Column) -> Column:
    s = F.lit(0)
    for j in range(5):
        mask = sum(1 << i for i in range(31) if (i + 1) >> j & 1)
        s = s + F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << j)
    return s


def anchors(fp: Column, max_bits: int) -> Column:
    """Array of the anchors (half << 32 | codeword) that the fingerprint is replicated to."""
    radius = 1 + -(-(max_bits // 2) // 2)
    table = F.expr("array(" + ",".join("array(" + ",".join(f"{e}L" for e in row) + ")" for row in error_patterns(radius)) + ")")
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)

    def near(half, side):
        return let(half, lambda h: F.transform(F.get(table, syndrome(h)), lambda e: h.bitwiseXOR(e) + F.lit(side << 32)))
    return F.concat(near(low, 0), near(high, 1))


def _spanning(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect ``values`` just as all pairs within ``max_bits`` do: (member, root) of each reached member."""
    left, members, roots = np.unique(values), [], []
    while len(left):
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root))
    empty = np.empty(0, np.uint64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (empty, empty)


def _compare_groups(max_bits: int):
    """Arrow map over rows (bucket, i, j, fp) sorted by group: a group at a time, whose size BLOCK bounds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(values):
        members, roots = _spanning(np.concatenate(values).view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(roots.view(np.int64))], schema=schema)

    def run(batches):
        key, values = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:3]:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                here = tuple(c[a] for c in cols[:3])
                if here != key and values:
                    yield links(values)
                    values = []
                key = here
                values.append(cols[3][a:b].astype(np.int64))
        if values:
            yield links(values)
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a, b``: links between different fingerprints of ``fps`` (distinct ``fp``) that have the same connected
    components as all pairs at ``max_bits`` or fewer bits.

    Anchors with one fingerprint are dropped by a partial aggregate, those with two are compared in it. Anchors with
    more get their rows back by a join; one with over BLOCK is dealt to blocks by hash and every two blocks meet in
    a group of their own, so a group holds about two blocks however many fingerprints crowd around an anchor."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits: 0 to 7")
    placed = fps.select("fp", F.explode(anchors(F.col("fp"), max_bits)).alias("bucket"))
    buckets = written(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                      .where((F.col("n") > 2) | (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.col("n") == 2)), "buckets")
    pairs = buckets.where("n = 2").select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    crowded = (placed.join(buckets.where("n > 2").select("bucket", blocks.alias("blocks")), "bucket")
               .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))
    grouped = crowded.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return pairs.unionByName(grouped.mapInArrow(_compare_groups(max_bits), "a long, b long")).distinct()


def near_duplicates(df: DataFrame, key: list[str], text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``df``: the ``key`` columns, ``fp`` and ``component``, the smallest fingerprint that links
    lead to. Texts are equal in ``component`` exactly if a chain of links joins them.

    Defined cases: a null text is empty; texts without words have fingerprint 0, linked like any other; repeated rows
    and ties each stay a row; null keys are ordinary; an empty table gives an empty result; other columns are ignored."""
    from webloom.session import ship_package
    ship_package(df.sparkSession)
    rows = written(fingerprints(df, text, shingle, keep=key), "fingerprints")
    fps = written(rows.select("fp").distinct(), "distinct")
    parts = connected_components(fingerprint_links(fps, max_bits))
    full = fps.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))
    return rows.join(full, "fp").select(*[f"`{k}`" for k in key], "fp", "component")
