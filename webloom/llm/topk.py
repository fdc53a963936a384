"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are integer term weights. Documents are sorted by id and cut into ranges, the blocks; a block's forward index
is the matrix of its vectors, and its term maxima (and minima, since weights may be negative) bound every score in it.
Each query scores the block of its highest summed bound first, then those whose bound reaches its k-th score, a few of
the highest at a time while they are few, and leaves the others out. Documents lie in parts, queries in groups; a task
holds one part and lets one group pass, in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written
from webloom.session import bound_batches, ship_package

#: Documents of a block, documents packed into a row, and queries packed into a row and searched at once.
BLOCK, PACK, CHUNK = 64, 1024, 1024
#: Blocks of one matrix product, and the share of blocks from which on those left are scored without an order of each query.
TILE, MANY = 8, 0.125
#: Documents, and bytes of their vectors, that a task holds; products of two weights that are worth a task.
HELD, HELD_BYTES, WORTH = 2 ** 18, 2 ** 26, 3 * 10 ** 10
#: Integers up to here are exact in the products of a type.
EXACT = {np.float32: 2 ** 24, np.float64: 2 ** 53}

_PACKED = "part_key long, n int, dims int, ids binary, marks binary, times binary, vectors binary"


def quantised(vector, scale: int = 256):
    """floor(scale * x) of every component, as a double computed in double precision; null if the vector is null or
    has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _trimmed(vector):
    """A vector without its trailing zeros, which change no product."""
    back = F.array_position(F.reverse(F.transform(vector, lambda x: x != 0)), True)
    cut = F.when(back == 0, F.slice(vector, 1, 0)).otherwise(F.slice(vector, 1, (F.size(vector) - back + 1).cast("int")))
    return F.when(F.try_element_at(vector, F.lit(-1)) != 0, vector).otherwise(cut)


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    least, most = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    m = np.zeros((len(vectors), sizes.max(initial=0)), np.int64)
    m[np.arange(m.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return m


def _pack(rows: int):
    """Arrow map from sorted (id, mark, times, vector) rows to packed rows of at most ``rows`` vectors, padded with zeros."""
    names = ["part_key", "n", "dims", "ids", "marks", "times", "vectors"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def packed(held):
        ids, marks, times = (np.concatenate([x[c] for x in held]) for c in range(3))
        vectors = _stacked([x[3] for x in held])
        values = [marks[0], len(ids), vectors.shape[1], ids.tobytes(), *[_narrow(x).tobytes() for x in (marks, times, vectors)]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, rows - n)
                held.append([*[part.column(c).to_numpy() for c in range(3)], _narrow(_matrix(part.column(3)))])
                a, n = a + part.num_rows, n + part.num_rows
                if n == rows:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)
    return run


def _stacked(ms: list[np.ndarray]) -> np.ndarray:
    """Matrices one below the other, padded with zeros."""
    out = np.zeros((sum(map(len, ms)), max(m.shape[1] for m in ms)), np.result_type(*ms))
    at = 0
    for m in ms:
        out[at:at + len(m), :m.shape[1]] = m
        at += len(m)
    return out


def _longest(m: np.ndarray) -> float:
    """The largest Euclidean length of a row, and a little more."""
    return 1.001 * float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


class Part:
    """Documents and the bounds of their blocks."""

    def __init__(self, ids: np.ndarray, nth: np.ndarray, docs: np.ndarray):
        self.ids, self.nth, self.docs = ids, nth, docs
        cuts = np.arange(0, len(ids), BLOCK)
        self.highest, self.lowest = np.maximum.reduceat(docs, cuts, axis=0), np.minimum.reduceat(docs, cuts, axis=0)
        self.longest = _longest(np.maximum(self.highest.astype(np.float64), -self.lowest.astype(np.float64)))


class Chunk:
    """The running top-k of one chunk of queries."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray, k: int, times: np.ndarray | None = None):
        self.ids, self.numbers, self.vectors, self.k = ids, numbers, vectors, k
        self.times = np.ones(len(ids), np.int64) if times is None else times
        self.row, self.score, self.doc = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.kth = np.full(len(ids), -np.inf)
        self.scored = self.skipped = 0

    def _kind(self, part: Part) -> type:
        """The fastest type in which all scores and bounds are exact: no partial sum passes the product of two lengths."""
        most = _longest(self.vectors) * part.longest
        return next((kind for kind, least in EXACT.items() if most < least), object)

    def meet(self, ids: np.ndarray, nth: np.ndarray, docs: np.ndarray) -> None:
        self.search(Part(ids, nth, docs))

    def search(self, part: Part) -> None:
        """Search the blocks of a part. A query's own row is the first of those of its id and vector."""
        width = min(part.docs.shape[1], self.vectors.shape[1])
        kind = self._kind(part)
        q, zero = self.vectors[:, :width].astype(kind), np.zeros((), kind)
        bounds = np.maximum(q, zero) @ part.highest[:, :width].astype(kind).T
        bounds += np.minimum(q, zero) @ part.lowest[:, :width].astype(kind).T
        todo = np.ones(bounds.shape, bool)
        some = 1
        while (live := self._reached(bounds, todo)).any():
            many = some > 1 and live.mean() > MANY
            if not many and some < live.shape[1]:  # of each query the blocks of its highest bounds
                left = np.where(live, bounds, -np.inf)
                least = left.max(axis=1) if some == 1 else np.sort(left, axis=1)[:, -some]
                live &= np.asarray(bounds >= least[:, None], bool)
            self._visit(part, q, bounds, live, todo)
            some *= 4
        self.skipped += int(todo.sum())

    def _reached(self, bounds: np.ndarray, todo: np.ndarray) -> np.ndarray:
        return todo & np.asarray(bounds >= self.kth[:, None], bool)

    def _visit(self, part: Part, q: np.ndarray, bounds: np.ndarray, live: np.ndarray, todo: np.ndarray) -> None:
        """Score ``live`` blocks, tiles of the highest bounds first, but those whose bound k-th scores have passed by then."""
        n, blocks = live.shape
        tops = np.maximum.reduceat(np.where(live, bounds, -np.inf).max(axis=0), np.arange(0, blocks, TILE))
        found, waiting = [], 0
        for t in np.argsort(-tops, kind="stable"):
            a, z = t * TILE, min(blocks, (t + 1) * TILE)
            here = self._reached(bounds[:, a:z], live[:, a:z])
            rows, cols = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
            if not len(rows):
                continue
            at = np.arange(a * BLOCK, min(len(part.ids), z * BLOCK))
            if len(cols) < z - a:
                at = at[np.isin(at // BLOCK - a, cols)]
                docs = part.docs[at]
            else:
                docs = part.docs[at[0]:at[-1] + 1]
            scores = (q if len(rows) == n else q[rows]) @ docs[:, :q.shape[1]].astype(q.dtype).T
            self.scored += len(rows) * len(cols)
            hit = np.flatnonzero(np.asarray(scores.max(axis=1) >= self.kth[rows], bool))
            if len(hit) * 8 > len(rows):
                self._raise(rows, scores)
            if len(hit):
                i, j = np.nonzero(np.asarray(scores[hit] >= self.kth[rows[hit]][:, None], bool))
                i, j = hit[i], j
                new = todo[rows[i], at[j] // BLOCK]
                own = (part.ids[at[j]] == self.ids[rows[i]]) & (part.nth[at[j]] == 1)
                own[own] = _same(part.docs[at[j[own]]], self.vectors[rows[i[own]]])
                i, j = i[new & ~own], j[new & ~own]
                found.append((rows[i], scores[i, j], part.ids[at[j]]))
                waiting += len(i)
                if waiting > 2 * n:
                    self._merge(found)
                    found, waiting = [], 0
            todo[rows[:, None], a + cols] = False
        if waiting:
            self._merge(found)

    def _raise(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """Raise the k-th scores to what so many documents reach: the highest of k + 1 groups, one of which may be a query's own row."""
        spread = min(scores.shape[1], max(BLOCK, self.k + 1))
        if spread > self.k and scores.dtype != object:
            tops = scores[:, :scores.shape[1] // spread * spread].reshape(len(rows), -1, spread).max(axis=1)
            self.kth[rows] = np.maximum(self.kth[rows], np.partition(tops, -self.k - 1, axis=1)[:, -self.k - 1])

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        rows, scores, docs = zip(*found, strict=True)
        row, doc = np.concatenate([self.row, *rows]), np.concatenate([self.doc, *docs])
        score = np.concatenate([self.score, *scores])
        if score.dtype == object:
            at = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], doc[i])))
        else:
            at = np.lexsort((doc, -score, row))
        row, score, doc = row[at], score[at], doc[at]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        top = place < self.k
        self.row, self.score, self.doc = row[top], score[top], doc[top]
        last = place == self.k - 1
        self.kth = self.kth.astype(score.dtype)
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[last])

    def results(self) -> pa.RecordBatch:
        scores = pa.array([int(s) for s in self.score], pa.int64())  # fails beyond a long
        return pa.RecordBatch.from_arrays([pa.array(self.numbers[self.row]), pa.array(self.ids[self.row]), pa.array(self.times[self.row]),
                                           pa.array(self.doc), scores], names=["number", "query_id", "times", "doc_id", "score"])


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows are equal, the shorter ones padded with zeros."""
    w = min(a.shape[1], b.shape[1])
    return (a[:, :w] == b[:, :w]).all(axis=1) & ~a[:, w:].any(axis=1) & ~b[:, w:].any(axis=1)


def _search(k: int):
    """Arrow map over (task, asks, n, dims, ids, marks, times, vectors), of each task the documents before the queries."""
    def whole(held):
        ids, marks, times = (np.concatenate([x[c] for x in held]) for c in range(3))
        return ids, marks, times, _stacked([x[3] for x in held])

    def numbers(data, n):
        return np.frombuffer(data, f"i{len(data) // n}").astype(np.int64)

    def found(part, asked):
        ids, marks, times, vectors = whole(asked)
        chunk = Chunk(ids, marks, vectors, k, times)
        chunk.search(part)
        return chunk.results()

    def run(batches):
        key, part, docs, asked, waiting = None, None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                task, asks, n, dims, ids, marks, times, vectors = (batch.column(c)[i].as_py() for c in range(8))
                if task != key:
                    if asked:
                        yield found(part, asked)
                    key, part, docs, asked, waiting = task, None, [], [], 0
                m = np.frombuffer(vectors, f"i{len(vectors) // (n * dims)}").reshape(n, dims) if dims else np.zeros((n, 0), np.int8)
                row = np.frombuffer(ids, np.int64), numbers(marks, n), numbers(times, n), m
                if not asks:
                    docs.append(row)
                    continue
                if docs:
                    ids, nth, _, m = whole(docs)
                    part, docs = Part(ids, nth, m), []
                if part is None:  # no document was dealt to this task
                    continue
                asked.append(row)
                waiting += n
                if waiting >= CHUNK:
                    yield found(part, asked)
                    asked, waiting = [], 0
        if asked:
            yield found(part, asked)
    return run


def _grid(docs: int, size: int, packs: int, dims: int, asked: int, most: int) -> tuple[int, int]:
    """Parts of the documents and groups of the queries, so that few rows are copied: parts are copied to each group, groups
    to each part. ``size`` is the bytes of the documents' vectors. There are ``most`` tasks or fewer, but as many as hold
    all documents; where they would copy more than three times all rows, fewer and up to 64 times as long."""
    if not docs or not asked:
        return 1, 1
    work, chunks = docs * asked * max(1, dims), -(-asked // CHUNK)
    frugal = max(9 * (docs + asked) ** 2 // (4 * docs * asked), -(-work // (64 * WORTH)))
    tasks = max(1, min(most, -(-work // WORTH), frugal))
    groups = max(1, min(tasks, chunks, round((tasks * asked / docs) ** 0.5 + 0.2)))  # rather larger parts
    parts = min(packs, max(-(-tasks // groups), -(-docs // HELD), -(-size // HELD_BYTES)))
    return parts, min(chunks, max(groups, tasks // parts))


def _dealt(rows: DataFrame, n: int):
    """``rows`` with a column ``share`` below ``n``, dealt out in turn inside each task, which begin far from one another."""
    at = rows.withColumn("__at", F.monotonically_increasing_id())
    first = F.floor(F.pmod(F.shiftright("__at", 33) * F.lit(0.6180339887498949), F.lit(1.0)) * n)
    return at.withColumn("share", F.pmod(first + F.col("__at").bitwiseAND(F.lit(2 ** 33 - 1)), F.lit(n)).cast("int")).drop("__at")


def exact_topk(docs: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id, rank (from 1), doc_id, score``: of each query the ``k`` documents of largest inner product (all, if
    fewer), ties to the smaller id. A query's own row, a document of its id and vector, is left out once; other rows of
    its id, and further copies of the row, are candidates.

    Both tables hold ``key`` long and ``vector`` array<long>. Rows with a null key, vector or component take no part; a shorter
    vector counts as padded with zeros, an empty one scores 0; repeated documents are candidates each, repeated queries
    ask each. A score in the result that passes a long fails the job. Empty tables give an empty result.

    Equal documents are counted before they are dealt; k + 1 rows of each are packed, as no result can hold more of
    them. Documents are dealt by id range (and a hash of the vector), packed PACK to a row, queries CHUNK to a row, in
    the smallest type that holds their weights. Packed rows meet in a grid of tasks, one for each part of the documents
    and group of the queries: there is no join, so nothing is broadcast, and the driver gets counts and samples of ids
    and hashes alone. A task holds one part (about HELD documents at most) and one chunk. At most k rows a query and
    part are ranked at the end."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)

    def counted(rows):
        held = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id is not null and v is not null")
        held = held.where(~F.exists("v", lambda x: x.isNull()))
        return held.select("id", _trimmed(F.col("v")).alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    once = F.lit(1).cast("long")
    d = counted(docs).select("id", F.explode(F.sequence(once, F.least("n", F.lit(k + 1)))).alias("nth"), once.alias("times"), "v")
    q = written(counted(queries).withColumn("number", F.monotonically_increasing_id()), "queries")
    n = q.count()
    keys = ["id", "same", "nth"]  # Spark samples what it deals by for the driver: not vectors
    ranged = d.withColumn("same", F.xxhash64("v")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "nth", "times", "v")
    packed = written(ranged.mapInArrow(_pack(PACK), _PACKED), "packed")
    chunks = (q.repartitionByRange(max(1, -(-n // CHUNK)), "number").sortWithinPartitions("number").select("id", "number", "n", "v")
              .mapInArrow(_pack(CHUNK), _PACKED))
    size = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("vectors")), F.lit(0)), F.count(F.lit(1)),
                      F.coalesce(F.max("dims"), F.lit(0))).first()
    parts, groups = _grid(*size, n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ["n", "dims", "ids", "marks", "times", "vectors"]

    def copied(dealt, share: int, other: int, asks: int):
        """Packed rows dealt to ``share`` rows (columns) of the grid, copied to all ``other`` tasks of it."""
        each = _dealt(dealt, share).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        part, group = ("copy", "share") if asks else ("share", "copy")
        return each.select((F.col(part) * groups + F.col(group)).alias("task"), F.lit(asks).alias("asks"), "part_key", *rows)
    met = copied(packed, parts, groups, 0).union(copied(chunks, groups, parts, 1)).repartitionById(parts * groups, "task")
    best = (met.sortWithinPartitions("task", "asks", "part_key").select("task", "asks", *rows)
            .mapInArrow(_search(k), "number long, query_id long, times long, doc_id long, score long"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    asked = ranked.withColumn("__ask", F.explode(F.sequence(once, "times")))
    return asked.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
