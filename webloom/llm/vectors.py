"""Embedding near-duplicates on a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards. Each shard builds a robust-pruned neighbour graph, the adjacency
lists of a vector from all its shards are united into one flat graph, and every vector searches it from itself, the
medoids and a vector of each connected part of the graph: greedily to its neighbourhood, then by widening the search through all vectors in range. What is found is verified
by cosine in double precision, and the recall of the whole is audited against brute force for a bounded sample."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import written
from webloom.llm.components import connected_components
from webloom.session import ship_package

#: Vectors the clusters are fitted on, and the most clusters there can be.
SAMPLE, MAX_CLUSTERS = 16_384, 1024
#: Home vectors a cluster should have, and the most vectors of a shard: a larger cluster is split by hash.
CLUSTER, SHARD = 1000, 4096
#: Out-degree of a shard's graph, candidates looked at in pruning, and the pruning's slack.
DEGREE, CANDIDATES, ALPHA = 24, 96, 1.2
#: Entry points of a shard's search, and how far below the threshold the widening search still expands.
MEDOIDS, SLACK = 8, 0.05
#: Vectors compared with brute force in the audit.
AUDIT = 1024

_LINKS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array<double>) of the rows that can link: not null, all components finite, some not zero."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(f"`{key}`").alias("id"), v.alias("v"))
            .where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_clusters(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread over the sample."""
    x = unit(sample)
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        best = np.argmax(x @ centres.T, axis=1)
        for c in range(n):
            mine = x[best == c]
            if len(mine) and np.linalg.norm(s := mine.sum(axis=0)) > 0:
                centres[c] = s / np.linalg.norm(s)
    return centres


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assign(centres: np.ndarray, margin: float):
    """Arrow map (id, copies, v) -> (id, copies, v, cluster, home): every cluster within ``margin`` of the nearest."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = unit(_matrix(part.column(2), centres.shape[1])) @ centres.T
                home = near.argmax(axis=1)
                row, cluster = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cluster.astype(np.int32)), pa.array(home[row] == cluster)],
                                                 names=["id", "copies", "v", "cluster", "home"])
    return run


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of ``x`` (unit vectors): the nearest candidate stays, and drops every other that is nearer
    to it by ALPHA than to the row itself, until DEGREE stay."""
    out, n = [], len(x)
    wide = min(CANDIDATES, n - 1)
    for at in range(0, n, 512):
        near = x[at:at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        top = np.argpartition(-near, wide - 1, axis=1)[:, :wide] if wide < n - 1 else np.argsort(-near, axis=1)[:, :wide]
        for i, c in enumerate(top):
            c = c[np.argsort(-near[i, c], kind="stable")]
            away = 2 - 2 * near[i, c]  # squared distances
            between = 2 - 2 * (x[c] @ x[c].T)
            alive, kept = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    kept.append(c[j])
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * ALPHA * between[j] > away
            out.append(np.array(kept))
    return out


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One shard (id, v): its pruned graph, both ways, as (a, b) rows."""
    ids = table.column("id").to_numpy()
    a, b = [], []
    if len(ids) > 1:
        v = table.column("v").combine_chunks()
        order = np.argsort(ids)
        ids, x = ids[order], unit(_matrix(v, len(v[0])))[order]
        for i, kept in enumerate(robust_prune(x)):
            a.append(np.full(len(kept), ids[i]))
            b.append(ids[kept])
    a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
    return pa.table({"a": pa.array(np.concatenate([a, b]), pa.int64()), "b": pa.array(np.concatenate([b, a]), pa.int64())})


def medoids(x: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, then the row least like those taken, MEDOIDS in all."""
    taken = [int(np.argmax(x @ x.mean(axis=0)))]
    like = x @ x[taken[0]]
    while len(taken) < min(MEDOIDS, len(x)):
        taken.append(int(np.argmin(like)))
        like = np.maximum(like, x @ x[taken[-1]])
    return np.array(taken)


def entries(x: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Where every search on a graph begins: the medoids, and one row of each connected part."""
    row, place = np.nonzero(neighbours >= 0)
    moved, _ = _forest(len(x), np.stack([row, neighbours[row, place]], axis=1))
    return np.union1d(medoids(x), np.setdiff1d(np.arange(len(x)), moved))


def range_search(x: np.ndarray, neighbours: np.ndarray, asking: np.ndarray, floor: float, beam: int,
                 start: np.ndarray | None = None) -> np.ndarray:
    """For each row of ``asking``, whether each row of ``x`` was seen by a search on the graph ``neighbours`` (padded
    with -1): greedy with ``beam`` best candidates from the row itself and from ``start`` (default: :func:`entries`),
    then on through every row at ``floor`` or more."""
    n, m = len(asking), len(x)
    q = x[asking]
    near = np.full((n, m + 1), -2.0, np.float32)  # similarity where seen; column m takes the padding
    start = entries(x, neighbours) if start is None else start
    near[:, start] = q @ x[start].T
    near[np.arange(n), asking] = 1
    done = np.zeros((n, m + 1), bool)
    done[:, m] = True

    def expand(rows, nodes):
        done[rows, nodes] = True
        to = neighbours[nodes]
        row = np.repeat(rows, to.shape[1])
        to = to.ravel()
        fresh = (to >= 0) & (near[row, to] == -2)
        row, to = row[fresh], to[fresh]
        for at in range(0, len(row), 1 << 16):
            r, t = row[at:at + (1 << 16)], to[at:at + (1 << 16)]
            near[r, t] = np.einsum("ij,ij->i", q[r], x[t])

    active = np.arange(n)
    while len(active):  # greedy: the best candidate not yet expanded, as long as it is among the beam best
        open_ = np.where(done[active], -3.0, near[active])
        best = open_.argmax(axis=1)
        value = open_[np.arange(len(active)), best]
        wide = min(beam, m) - 1
        bar = -np.partition(-near[active, :m], wide, axis=1)[:, wide]
        go = (value >= np.maximum(bar, -1.5))
        active, best = active[go], best[go]
        if len(active):
            expand(active, best)
    while True:  # widening: all in range
        rows, nodes = np.nonzero((near >= floor) & ~done)
        if not len(rows):
            return near[:, :m] >= floor
        for at in range(0, len(rows), 1 << 14):
            expand(rows[at:at + (1 << 14)], nodes[at:at + (1 << 14)])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, in double precision."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _search(threshold: float, beam: int | None):
    """Group map of one cell (two sub-shards i <= j of a cluster), by brute force if ``beam`` is None: rows kind, a, b. ``n``: b copies link with a;
    ``t``: a and b hang together; ``x``: a link between vectors of different homes, which other cells may find too."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells = [c.as_py() for c in key]
        i, j = cells[1], cells[2]
        order = np.argsort(table.column("id").to_numpy())
        table = table.take(pa.array(order))
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        home, sub = table.column("home").to_numpy(zero_copy_only=False).astype(bool), table.column("sub").to_numpy()
        v = table.column("v").combine_chunks()
        raw = _matrix(v, len(v[0]))
        x = unit(raw)
        graph = _flat(ids, table.column("nbrs").combine_chunks())
        links = np.zeros((0, 2), np.int64)
        asking = np.flatnonzero(home)
        start = entries(x, graph) if beam else None
        for at in range(0, len(asking), 256):
            mine = asking[at:at + 256]
            seen = range_search(x, graph, mine, threshold - SLACK, beam, start) if beam else x[mine] @ x.T >= threshold - 1e-9
            r, c = np.nonzero(seen)
            a, b = mine[r], c
            ok = (a != b) & ((sub[a] != sub[b]) | (i == j))
            a, b = a[ok], b[ok]
            good = np.concatenate([cosines(raw[a[z:z + 65536]], raw[b[z:z + 65536]]) >= threshold for z in range(0, len(a), 65536)] or [np.empty(0, bool)])
            links = np.concatenate([links, np.stack([np.minimum(a[good], b[good]), np.maximum(a[good], b[good])], axis=1)])
        links = np.unique(links, axis=0)
        inner = home[links[:, 0]] & home[links[:, 1]]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, links[inner, 0], copies[links[inner, 1]])
        np.add.at(count, links[inner, 1], copies[links[inner, 0]])
        linked = np.flatnonzero(count)
        u, w = _forest(len(ids), links)
        outer = links[~inner]
        kind = ["n"] * len(linked) + ["t"] * len(u) + ["x"] * len(outer)
        return pa.table({"kind": pa.array(kind, pa.string()), "a": pa.array(np.concatenate([ids[linked], ids[u], ids[outer[:, 0]]]), pa.int64()),
                         "b": pa.array(np.concatenate([count[linked], ids[w], ids[outer[:, 1]]]), pa.int64())})
    return run


def _flat(ids: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Neighbour positions among ``ids`` (sorted), padded with -1; neighbours outside are left out."""
    to = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(ids)), sizes)
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    inside = ids[at] == to
    row, at = row[inside], at[inside]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    flat = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
    flat[row, place] = at
    return flat


def _forest(n: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node whose component has a smaller one."""
    root = np.arange(n)
    while len(links):
        low = root.copy()
        np.minimum.at(low, links[:, 0], root[links[:, 1]])
        np.minimum.at(low, links[:, 1], root[links[:, 0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def find_links(reps: DataFrame, threshold: float, margin: float, beam: int | None) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (id, copies, v) of one length: (id, n) with the copies of other vectors linked to each, and
    (a, b) links that connect what is linked. Without a ``beam`` every cell is compared by blocks of brute force."""
    spark = reps.sparkSession
    n = reps.count()
    sample = np.array([r.v for r in reps.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()])
    clusters = max(1, min(MAX_CLUSTERS, -(-n // CLUSTER), len(sample)))
    centres = fit_clusters(sample, clusters)
    held = spark.sparkContext.broadcast(centres)  # MAX_CLUSTERS vectors at most

    def assign(batches):
        yield from _assign(held.value, margin)(batches)
    placed = written(reps.select("id", "copies", "v").mapInArrow(assign, "id long, copies long, v array<double>, cluster int, home boolean"), "placed")
    sizes = {r.cluster: r["count"] for r in placed.groupBy("cluster").count().collect()}  # one row a cluster
    subs = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(-(-s // SHARD))) for c, s in sorted(sizes.items())))
    placed = placed.withColumn("subs", subs[F.col("cluster")]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    edges = placed.select("cluster", "sub", "id", "v").groupBy("cluster", "sub").applyInArrow(_build, "a long, b long")
    graph = written(edges.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("nbrs")), "graph")
    cells = (placed.join(graph, "id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
             .withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<bigint>")))
             .select("cluster", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "id", "copies", "v", "home", "sub", "nbrs"))
    found = written(cells.groupBy("cluster", "i", "j").applyInArrow(_search(threshold, beam), _LINKS), "found")
    outer = found.where("kind = 'x'").select("a", "b").distinct()
    mult = reps.select("id", "copies")
    ends = outer.unionByName(outer.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(mult.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("copies").alias("n"))
    counts = found.where("kind = 'n'").select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(far)
    return counts.groupBy("id").agg(F.sum("n").alias("n")), found.where("kind <> 'n'").select("a", "b")


def audit(reps: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Share of the links of AUDIT vectors (of least hash) that were found; the truth is brute force over all rows."""
    spark = reps.sparkSession
    picked = written(reps.join(counts, "id", "left").select("id", "v", F.coalesce("n", F.lit(0)).alias("n"))
                     .orderBy(F.xxhash64("id"), "id").limit(AUDIT), "audit")
    rows = picked.collect()
    if not rows:
        return 1.0
    asked = np.array([r.v for r in rows])
    asked_ids = np.array([r.id for r in rows])
    held = spark.sparkContext.broadcast((asked_ids, asked))

    def run(batches):
        ids, q = held.value
        total, u = np.zeros(len(ids), np.int64), unit(q)
        for batch in batches:
            y = _matrix(batch.column(2), q.shape[1])
            z, own = unit(y), batch.column(0).to_numpy()
            copies = batch.column(1).to_numpy()
            for at in range(0, len(y), 4096):
                r, c = np.nonzero(u @ z[at:at + 4096].T >= threshold - 1e-9)
                c = c + at
                good = (ids[r] != own[c]) & (cosines(q[r], y[c]) >= threshold) if len(r) else np.empty(0, bool)
                np.add.at(total, r[good], copies[c[good]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])
    truth = {r.id: r.n for r in reps.select("id", "copies", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    whole = sum(truth.values())
    return sum(min(r.n, truth[r.id]) for r in rows) / whole if whole else 1.0


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    target: float = 0.98, margin: float = 0.1, beam: int = 24, rounds: int = 3) -> DataFrame:
    """One row per row of ``df``: ``key, n_links, component_id, kept, recall``.

    ``n_links``: other rows linked directly by a cosine of at least ``threshold``; ``component_id``: the smallest key
    reachable; ``kept``: whether that is the row's own; ``recall``: of the audit. If the audit finds less than
    ``target``, shards overlap more and the beam doubles, ``rounds`` times at most; after that all cells are compared
    by brute force.

    Exact copies are one vector with a count, so they cost nothing and link with each other. Null, zero and non-finite
    vectors, and those of another length than the table's most frequent one, link with nothing. A repeated key is
    two rows that link by their vectors; a null key is reported with its own null component unless a link gives it
    one. An empty table gives an empty result. Other columns are ignored."""
    ship_package(df.sparkSession)
    good = written(valid_vectors(df, key, vector), "vectors")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = df.select(F.col(f"`{key}`").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v"))
    if sizes is None:
        return out.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                          F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    # rows of equal vectors are one class; its number is given once, as the table is written
    classes = written(good.where(F.size("v") == sizes.d).groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("id", "copies", "v")
    for attempt in range(rounds + 1):
        counts, links = find_links(reps, threshold, margin, beam if attempt < rounds else None)
        counts = written(counts, "counts")
        recall = audit(reps, counts, threshold)
        if recall >= target:
            break
        margin, beam = margin * 1.5, beam * 2
    parts = connected_components(links)
    full = written(classes.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "id", "left")
                   .select("v", "first", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n")), "joined")
    least = full.groupBy("component").agg(F.min("first").alias("component_id"))
    known = full.join(least, "component").select("v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = out.join(known, "v", "left")
    part = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"),
                         part.eqNullSafe(F.col("id")).alias("kept"), F.lit(float(recall)).alias("recall"))
