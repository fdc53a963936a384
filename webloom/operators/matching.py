"""Many patterns in many texts: every row is searched once for all patterns by an Aho-Corasick automaton.

What a query costs is its patterns' size in the automaton and its hits; rows are never paired with queries. Patterns
are broadcast in blocks of bounded size, whole queries each, so a query table of any size can be asked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import materialize, ship_package

#: Patterns of a block, and their characters: what a broadcast may hold (a longer single query is a block alone).
BLOCK_PATTERNS, BLOCK_CHARS = 100_000, 4_000_000
#: Rows looked at together, and rows of an output batch.
SLICE, OUT = 256, 4096

#: The automaton that a worker has built last, and of which broadcast.
_BUILT: dict = {}


def automaton(postings: list[tuple[str, list[tuple[int, int]]]]):
    """Patterns as keys, their number as value; the library's trie has failure links once it is made."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for i, (pattern, _) in enumerate(postings):
        found.add_word(pattern, i)
    if postings:
        found.make_automaton()
    return found


def scores(found, postings: list[tuple[str, list[tuple[int, int]]]], always: dict[int, int], text: str) -> dict[int, int]:
    """Summed weights by query number, each pattern counted once however often it occurs."""
    out = dict(always)
    hits = {i for _, i in found.iter(text)} if postings else ()
    for i in hits:
        for query, weight in postings[i][1]:
            out[query] = out.get(query, 0) + weight
    return out


def pattern_scores(rows: DataFrame, lowered: Column, patterns: DataFrame, score: str) -> DataFrame:
    """The columns of ``rows``, then ``query`` and ``score``: one row for each query of which a pattern is a substring of
    ``lowered``, with the sum of its found patterns' weights (int).

    ``patterns``: ``query, pattern, weight``; an empty pattern is in every text. A null text has no hits, repeated rows are
    scored each, and columns of ``rows`` named like an added one are replaced. Each block of patterns is a pass over the rows."""
    spark = rows.sparkSession
    ship_package(spark)
    once = patterns.where("query is not null and pattern is not null").groupBy("query", "pattern").agg(F.max("weight").alias("weight"))
    size = once.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("pattern") + 1).alias("chars"))
    total = size.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    blocks = max(1, -(-(total["n"] or 0) // BLOCK_PATTERNS), -(-(total["chars"] or 0) // BLOCK_CHARS))
    dealt = materialize(once.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "patterns")
    kept = [c for c in rows.columns if c.lower() not in ("query", score.lower())]
    src = rows.select(*[F.col(f"`{c}`") for c in kept], lowered.alias("__text"))
    schema = T.StructType([src.schema[c] for c in kept] + [T.StructField("query", T.StringType()), T.StructField(score, T.IntegerType())])
    out = None
    for block in range(blocks):
        part = _searched(src, dealt.where(F.col("block") == block), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _searched(src: DataFrame, block: DataFrame, schema: T.StructType) -> DataFrame:
    found = block.select("query", "pattern", "weight").collect()  # bounded by the size of a block
    queries = sorted({r["query"] for r in found})
    number = {q: i for i, q in enumerate(queries)}
    by_pattern: dict[str, list[tuple[int, int]]] = {}
    for r in found:
        by_pattern.setdefault(r["pattern"], []).append((number[r["query"]], r["weight"]))
    always = dict(by_pattern.pop("", []))
    shared = src.sparkSession.sparkContext.broadcast((queries, sorted(by_pattern.items()), always))
    names, arrow, token = schema.names, to_arrow_schema(schema), uuid.uuid4().hex

    def batch(part: pa.RecordBatch, row: list[int], query: list[str], score: list[int]) -> pa.RecordBatch:
        taken = part.take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(query, arrow.field(len(names) - 2).type),
                                           pa.array(score, pa.int32())], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        queries, postings, always = shared.value
        if _BUILT.get("of") != token:  # one automaton a worker, for the block it works on
            _BUILT.clear()
            _BUILT.update({"of": token, "automaton": automaton(postings)})
        words = _BUILT["automaton"]
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                row, query, score = [], [], []
                for r, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if text is None:
                        continue
                    for q, s in scores(words, postings, always, text).items():
                        row.append(r)
                        query.append(queries[q])
                        score.append(s)
                        if len(row) == OUT:
                            yield batch(part, row, query, score)
                            row, query, score = [], [], []
                if row:
                    yield batch(part, row, query, score)
    return src.mapInArrow(run, schema)
