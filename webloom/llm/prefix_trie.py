"""Conversation prefix trie by time-forward processing.

Conversations are sorted by their sequence of turns and cut into shards, ranges of that order. The members of a node (the
conversations that start with one sequence of turns) follow each other there, so a node lies whole inside a shard unless it
is a prefix of the shard's first or last conversation. Those, at most two paths a shard, are the shard's roots.

Inside each shard the nodes are sorted externally by reverse level order, and every node hands its subtree's totals to its
parent through a priority queue keyed by the parent's place in that order, which spills sorted runs to disk. What
reaches a shard root is added up over shards, and the same pass goes over the tree of the roots."""

from __future__ import annotations

import hashlib
import heapq
import marshal
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import quoted, written
from webloom.session import ship_package

#: Messages a queue holds in memory, and rows of an output batch.
QUEUE, ROWS = 200_000, 2048
#: Bytes of a turn's digest, and ids of a node's ending conversations that are joined into one row.
DIGEST, ENDS = 16, 4096

_NODES = ("shard int, first long, depth int, pfirst long, conv long, n long, words long, key binary, pkey binary, root boolean, "
          "ends string, kind int, part long")


class SpillingQueue:
    """A priority queue of tuples. Beyond ``limit`` tuples in memory, all of them go to disk as a sorted run, read back
    in slices. Runs are scratch of the one task that wrote them, beside Spark's own spills; a task that is run again
    begins without them."""

    SLICE = 4096

    def __init__(self, limit: int | None = None):
        self.limit = limit or QUEUE
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (next tuple, run number)
        self.runs: dict[int, Iterator[tuple]] = {}
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.heap.sort()
        for at in range(0, len(self.heap), self.SLICE):
            marshal.dump(self.heap[at:at + self.SLICE], run)
        run.seek(0)
        self.heap, number = [], self.spilled
        self.spilled += 1
        self.runs[number] = self._read(run)
        self._advance(number)

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from marshal.load(run)
                except EOFError:
                    return

    def _advance(self, number: int) -> None:
        item = next(self.runs[number], None)
        if item is None:
            del self.runs[number]
        else:
            heapq.heappush(self.heads, (item, number))

    def pop_below(self, bound: tuple) -> Iterator[tuple]:
        """Take out, in order, every tuple below ``bound``."""
        while True:
            disk = self.heads[0][0] if self.heads else None
            if self.heap and (disk is None or self.heap[0] <= disk):
                if self.heap[0] >= bound:
                    return
                yield heapq.heappop(self.heap)
            elif disk is not None and disk < bound:
                yield disk
                self._advance(heapq.heappop(self.heads)[1])
            else:
                return


def subtree_totals(nodes: Iterator[tuple]) -> Iterator[tuple]:
    """Time-forward pass over ``(group, depth, id, parent id, own leaves, own saved, children, root)`` sorted by group,
    depth falling, id. Gives ``(n_children, n_leaves, saved)`` for each: own values plus all children's. A node without
    any child is a leaf. A root node keeps what it receives: its totals are not sent on."""
    queue = SpillingQueue()
    for group, depth, ident, parent, leaves, saved, children, root in nodes:
        for message in queue.pop_below((group, -depth, ident, 1)):
            if message[:3] == (group, -depth, ident):
                children, leaves, saved = children + 1, leaves + message[4], saved + message[5]
        if not root:
            leaves = leaves if children else 1
            if parent is not None:  # 0 sorts a message before the bound of its parent
                queue.push((group, 1 - depth, parent, 0, leaves, saved))
        yield children, leaves, saved


def _columns(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], pa.list_(pa.int64()) if f.split()[1] == "array<long>" else kinds[f.split()[1]]) for f in ddl.split(", ")])


def _mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """Arrow map by a generator over rows as tuples."""
    ship_package(df.sparkSession)
    schema = _arrow(ddl)
    return df.mapInArrow(lambda batches: _batches(fn(_columns(batches)), schema), ddl)


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv, path`` (the digests of its turns, one after the other) and ``words`` (of each turn's
    text). Turns are ordered by turn (null first), then role and text; a null role or text is empty, repeated rows are
    turns each, rows without a conversation id are left out. Texts are shuffled once by conversation and sorted on disk;
    a task holds 24 bytes of each turn of one conversation, not its texts."""
    rows = turns.select(quoted(conv).cast("long").alias("c"), quoted(turn).alias("t"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("r"),
                        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("x")).where("c IS NOT NULL")

    def gather(rows):
        now, path, words = None, bytearray(), []
        for c, _, r, x in rows:
            if c != now:
                if now is not None:
                    yield now, bytes(path), words
                now, path, words = c, bytearray(), []
            said, who = x.encode(), r.encode()
            path += hashlib.blake2b(b"%d:%b%b" % (len(who), who, said), digest_size=DIGEST).digest()
            words.append(len(said.split()))  # bytes split at the six ASCII white spaces
        if now is not None:
            yield now, bytes(path), words
    return _mapped(rows.repartition("c").sortWithinPartitions("c", "t", "r", "x"), gather, "conv long, path binary, words array<long>")


def rebuilt(convs: DataFrame, base: Column, head: Column) -> DataFrame:
    """Every conversation with its first ``head`` turns taken from conversation ``base`` (all if it has fewer, none if there
    is no such one), then its own turns after the first ``head``."""
    own = convs.select("conv", "path", "words", base.cast("long").alias("base"), head.cast("int").alias("h"))
    other = convs.select(F.col("conv").alias("base"), F.col("path").alias("bpath"), F.col("words").alias("bwords"))
    width = F.col("h") * DIGEST
    joined = own.join(other, "base", "left")
    return joined.select("conv",
                         F.concat(F.coalesce(F.substring(F.col("bpath"), F.lit(1), width), F.lit(b"")),
                                  F.substring(F.col("path"), width + 1, F.greatest(F.length("path") - width, F.lit(0)))).alias("path"),
                         F.concat(F.coalesce(F.slice("bwords", F.lit(1), F.col("h")), F.array().cast("array<long>")),
                                  F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0)))).alias("words"))


def _keys(path: bytes) -> list[bytes]:
    """The key of every prefix of a path, by its number of turns."""
    state = hashlib.blake2b(digest_size=DIGEST)
    keys = [state.digest()]
    for at in range(0, len(path), DIGEST):
        state.update(path[at:at + DIGEST])
        keys.append(state.copy().digest())
    return keys


def _common(a: bytes, b: bytes) -> int:
    """Turns at the start of both."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * DIGEST] == b[:mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def shard_nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of one shard from its conversations in order of (path, id), in the columns of ``_NODES``.

    A node's place is (index of its first conversation, depth). ``root``: a prefix of the shard's first or last path, which
    other shards may hold as well; it has a key by its whole sequence. Ends of a node are ids of conversations that have no
    further turn, in order: a digest if all lie inside (``ends``), else rows of kind 1 hold them, joined, for a later merge."""
    from pyspark import TaskContext
    shard = TaskContext.get().partitionId()
    stack: list[list] = []  # first, smallest id, words, ends, open (ends are in rows of kind 1), by depth
    before, index, opening, opening_keys = None, -1, b"", []
    run: list[str] = []  # ids that end at the present path, not yet written out
    parts = 0

    def whole_key(path):
        return hashlib.blake2b(path, digest_size=DIGEST).digest()

    def held(path):
        nonlocal parts
        parts += 1
        return (shard, None, None, None, None, None, None, whole_key(path), None, None, ",".join(run), 1, parts)

    def close(down_to, path, last=False):
        keys = _keys(path) if last else opening_keys
        roots = len(keys) - 1 if last else _common(opening, path)  # deepest node that is a root
        while len(stack) > down_to:
            depth = len(stack) - 1
            first, least, words, ends, opened = stack.pop()
            root = depth <= roots
            keyed = keys[depth] if root else whole_key(path[:depth * DIGEST]) if opened else None
            parent = stack[-1] if stack else None
            if parent:
                parent[1] = min(parent[1], least)
            yield (shard, first, depth, parent[0] if parent else None, least, index - first + 1, words, keyed,
                   keys[depth - 1] if root and parent else None, root, None if opened else ends, 0, None)

    for conv, path, words in rows:
        if path != before:
            if run:
                node = stack[-1]
                if node[4] or before == opening:  # begun in another shard or written in parts: the rest as well
                    yield held(before)
                    node[4] = True
                else:
                    node[3] = hashlib.sha256(",".join(run).encode()).hexdigest()
                run = []
            same = 0 if before is None else _common(before, path)
            if before is None:
                opening, opening_keys = path, _keys(path)
            else:
                yield from close(same + 1, before)
            index += 1
            for depth in range(len(stack), len(path) // DIGEST + 1):
                stack.append([index, conv, words[depth - 1] if depth else 0, None, False])
            before = path
        else:
            index += 1
        stack[-1][1] = min(stack[-1][1], conv)
        run.append(str(conv))
        if len(run) == ENDS:
            yield held(path)
            stack[-1][4], run = True, []
    if before is not None:
        if run:
            yield held(before)
        stack[-1][4] = True
        yield from close(0, before, last=True)


def _whole_ends(parts: DataFrame) -> DataFrame:
    """``key, sha``: the digest of all ids of a node, from its rows of kind 1 in order. A digest is one sequence, so a node's
    rows pass through one task, as a stream; what is sorted are rows of up to ``ENDS`` ids each."""
    def run(rows):
        now, sha = None, None
        for key, _, _, ids in rows:
            if key != now:
                if now is not None:
                    yield now, sha.hexdigest()
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if now is not None:
            yield now, sha.hexdigest()
    rows = parts.select("key", "shard", "part", "ends").repartition("key").sortWithinPartitions("key", "shard", "part")
    return _mapped(rows, run, "key binary, sha string")


def _shard_totals(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Time-forward pass of whole shards: rows ``(shard, depth, first, pfirst, own saved, root, ...)`` sorted by shard, depth
    falling, first; the row with ``n_children, n_leaves, saved`` appended."""
    held: list[tuple] = []

    def nodes():
        for row in rows:
            held.append(row)
            shard, depth, first, pfirst, saved, root = row[:6]
            yield shard, depth, first, pfirst, 0, 0 if root else saved, 0, root
    for total in subtree_totals(nodes()):
        yield (*held.pop(), *total)


def _root_totals(rows: Iterator[tuple]) -> Iterator[tuple]:
    held: list[tuple] = []

    def nodes():
        for row in rows:
            held.append(row)
            depth, key, pkey, saved, children, leaves = row[:6]
            yield 0, depth, key, pkey, leaves, saved, children, False
    for total in subtree_totals(nodes()):
        yield (*held.pop(), *total)


def _parents(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``(shard, first, depth, conv, root, ...)`` sorted by shard, first, depth, which is the order of a walk from the
    top: the last conversation seen one level up is the parent's. Roots are only looked at."""
    at: dict[int, int] = {}
    for row in rows:
        _, _, depth, conv, root, *rest = row
        at[depth] = conv
        if not root:
            yield conv, depth, at[depth - 1], *rest


def trie(convs: DataFrame) -> DataFrame:
    """One row a node of the trie over ``conv, path, words``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens`` (all long) and ``ends_sha256``.

    Equal conversations are one path, sorted by id and dealt to shards by it as well, so a group of copies of any size is
    split. A common first turn makes long ranges, not large tasks. An empty table gives no rows.

    The tree of shard roots has at most two paths a shard, whatever the number of conversations; its pass is one sorted
    stream in one task. Shards are Spark's shuffle partitions."""
    nodes = written(_mapped(convs.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv").select("conv", "path", "words"),
                            shard_nodes, _NODES), "trie-nodes")
    sha = written(_whole_ends(nodes.where("kind = 1")), "trie-ends")
    tree = nodes.where("kind = 0").withColumn("own", (F.col("n") - 1) * F.col("words"))

    totals = written(_mapped(
        tree.select("shard", "depth", "first", "pfirst", "own", "root", "conv", "n", "words", "key", "pkey", "ends")
        .repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "first"), _shard_totals,
        "shard int, depth int, first long, pfirst long, own long, root boolean, conv long, n long, words long, key binary, pkey binary, "
        "ends string, n_children long, n_leaves long, saved long"), "trie-totals")

    roots = (totals.where("root").groupBy("key", "pkey", "depth")
             .agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"), F.max("ends").alias("ends"),
                  F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
             .withColumn("own", F.col("below") + (F.col("n") - 1) * F.col("words")))
    above = written(_mapped(
        roots.select("depth", "key", "pkey", "own", "inner", "leaves", "conv", "n", "ends")
        .repartition(1).sortWithinPartitions(F.desc("depth"), "key"), _root_totals,
        "depth int, key binary, pkey binary, own long, inner long, leaves long, conv long, n long, ends string, n_children long, n_leaves long, saved long"),
        "trie-roots")

    names = ["n", "n_children", "n_leaves", "saved", "key", "ends"]
    ends = totals.where("root").select("shard", "first", "depth", "key").join(above.select("key", "conv"), "key")
    walk = (totals.where("NOT root").select("shard", "first", "depth", "conv", "root", *names)
            .unionByName(ends.select("shard", "first", "depth", "conv", F.lit(True).alias("root")), allowMissingColumns=True)
            .repartition("shard").sortWithinPartitions("shard", "first", "depth"))
    inside = _mapped(walk, _parents, "conv long, depth int, parent long, n long, n_children long, n_leaves long, saved long, key binary, ends string")
    upper = above.join(above.select(F.col("key").alias("pkey"), F.col("conv").alias("parent")), "pkey", "left")
    every = inside.unionByName(upper.select("conv", "depth", "parent", *names))
    # only nodes that are shard roots, or whose ends were written in parts, have a key: the others stay out of the join
    keyed = every.where("key IS NOT NULL").join(sha, "key", "left")
    rest = every.where("key IS NULL").withColumn("sha", F.lit(None).cast("string"))
    return keyed.unionByName(rest).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", "ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
