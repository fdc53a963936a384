"""Language-model scoring: a unigram base and a gated recurrent network (GRU) with a class-factored output softmax.

Word counts cover every training document. The network's output is factored, P(word) = P(class) * P(word | class):
the most frequent words have classes of CLASS_WORDS with a softmax of their own each; the other counted words are in
classes by frequency and ending with their share of the class's counts; so are the words beyond the bounded head,
with 0.1 added to each count and to one unseen word. The sum over all words, seen or not, is one.

Texts are split once, into blocks of word codes that are written; counting, training and scoring read these.
Training is truncated backpropagation in numpy over every training document once, in rounds: the documents are dealt
to groups of bounded token count, more groups as the input grows; each round trains a copy on each of its groups and
averages the copies by tokens. Scoring carries the state from window to window through each whole document."""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import written
from webloom.session import ship_package

#: Words that every task knows (a bound for what is broadcast); all others are looked up by a join.
HEAD = 120_000
#: Words with an output and input vector of their own, words of a class, endings and frequency bins of other classes.
NEURAL, CLASS_WORDS, ENDINGS, BINS = 1024, 32, 8, 3
CLASSES = NEURAL // CLASS_WORDS + (BINS + 1) * ENDINGS
TAIL_CLASS = CLASSES - ENDINGS
#: State size, steps of a window, documents scored side by side, tokens that a task holds at once.
HIDDEN, WINDOW, LANES, HELD_TOKENS = 16, 32, 512, 1_000_000
#: States whose outputs are computed at once: fewer lanes have longer windows.
AT_ONCE = 8192
#: Training: tokens of a group (on average), rounds of averaging, step size.
GROUP, ROUNDS, RATE = 1 << 20, 3, 0.02
#: Lanes of a group, least and most; between them as many as give about STEPS updates in the pass over the group.
LEAST_LANES, TRAIN_LANES, STEPS = 64, 256, 128
#: Tokens of a piece of a long document, and tokens before a piece or lane that bring up its state.
PIECE, CONTEXT = 4096, 128
#: Tokens of a coded block, and how Parquet writes rows as large as these: sizes are looked at after a few.
BLOCK = 1 << 19
BLOCK_FILES = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 2}
END = b""  # the end token: words are never empty
SMOOTH = 0.1


def words_of(text: bytes | None) -> list[bytes]:
    """Words and the end token; bytes know A-Z and the six ASCII white-space characters only."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def ending(word: Column) -> Column:
    """Number of the ending class of a binary word: its last two bytes."""
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(ENDINGS)).cast("int")


class _Local(dict):
    """Words of a block by the order in which they came."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def coded(df: DataFrame, learn: Column, key: list[str], text: str) -> DataFrame:
    """Every text split once: one row per block of about BLOCK tokens, ``key`` (structs of the key columns), ``learn`` and
    ``sizes`` by document, ``codes`` (32-bit places in ``words`` of all tokens), the block's ``words`` and their ``times``
    in documents to learn from. A document is in one block; a longer one than BLOCK makes its block longer."""
    keys = F.struct(*([F.col(f"`{k}`") for k in key] or [F.lit(0).alias("none")]))
    src = df.select(keys.alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(f"`{text}`").cast("binary").alias("t"))
    schema = T.StructType([T.StructField("key", T.ArrayType(src.schema["key"].dataType)), T.StructField("learn", T.ArrayType(T.BooleanType())),
                           T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def block(parts, flats, sizes, table):
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        learned = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
        times = np.bincount(flat[np.repeat(learned, size)], minlength=len(table))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([
            one(pa.concat_arrays([p.column(0) for p in parts])), one(pa.array(learned)), one(pa.array(size)), pa.array([flat.tobytes()], pa.binary()),
            one(pa.array(list(table), pa.binary())), one(pa.array(times.astype(np.int64)))], names=schema.names)

    def run(batches):
        parts, flats, sizes, table, held = [], [], [], _Local(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, size = _numbers(table, part.column(2).to_pylist())
                parts.append(part)
                flats.append(flat)
                sizes.append(size)
                held += len(flat)
                if held >= BLOCK:
                    yield block(parts, flats, sizes, table)
                    parts, flats, sizes, table, held = [], [], [], _Local(), 0
        if parts:
            yield block(parts, flats, sizes, table)
    ship_package(df.sparkSession)
    return src.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def counts_of(blocks: DataFrame) -> DataFrame:
    """``word binary, c long`` over the documents of coded blocks to learn from: a word's times in each block, summed."""
    times = blocks.select(F.explode(F.arrays_zip("words", "times")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    return times.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


def count_words(texts: DataFrame) -> DataFrame:
    """``word binary, c long`` over column ``t`` (binary)."""
    return counts_of(coded(texts, F.lit(True), [], "t"))


class _Numbers(dict):
    """Head words by number; any other word is minus one minus its ending class."""

    def __missing__(self, word):
        return -1 - zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Head:
    """What a task knows of the vocabulary. Head words are numbered: the end token, then by falling count."""

    number: _Numbers
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    tail_total: np.ndarray  # by ending: counts and distinct words beyond the head
    tail_distinct: np.ndarray

    def __post_init__(self):
        n = len(self.counts)
        ends = np.fromiter((zlib.crc32(w[-2:]) % ENDINGS for w in self.number), np.int64, n)
        rank = np.arange(n)
        wide = max(n - NEURAL, 1)
        bins = np.minimum((np.log1p(np.maximum(rank - NEURAL, 0)) / np.log1p(wide) * BINS).astype(int), BINS - 1)
        self.cls = np.where(rank < NEURAL, rank // CLASS_WORDS, NEURAL // CLASS_WORDS + bins * ENDINGS + ends).astype(np.int32)
        self.inp = np.where(rank < NEURAL, rank, NEURAL + self.cls).astype(np.int32)
        mass = np.bincount(self.cls, weights=self.counts, minlength=CLASSES)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.own = np.where(rank < NEURAL, 0.0, np.log(self.counts / mass[self.cls])).astype(np.float32)
        self.mass = mass.copy()
        self.mass[TAIL_CLASS:] += self.tail_total + SMOOTH
        self.base = np.log10((self.counts + SMOOTH) / self.denominator)

    @property
    def denominator(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)


def learn_head(counts: DataFrame) -> Head:
    """From the whole count table. Words are taken from the most frequent down, by eighths of powers of two of the
    count, while they fit in HEAD; the driver gets at most HEAD words, 512 bin totals and ENDINGS sums."""
    level = F.floor(F.log2("c") * 8).cast("int")
    totals = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).collect()
    taken, least = 0, 1 << 30
    for r in sorted(totals, key=lambda r: -r.level):
        if taken + r.words > HEAD:
            break
        taken, least = taken + r.words, r.level
    inside = (level >= least) | (F.col("word") == F.lit(END))
    rows = sorted(((bytes(w), c) for w, c in counts.where(inside).select("word", "c").collect()), key=lambda x: (x[0] != END, -x[1], x[0]))
    tail_total, tail_distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.where(~inside).groupBy(ending(F.col("word")).alias("e")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).collect():
        tail_total[r.e], tail_distinct[r.e] = r.c, r.words
    if not rows:
        rows = [(END, 0)]
    return Head(_Numbers((w, i) for i, (w, _) in enumerate(rows)), np.array([c for _, c in rows], float), sum(r.c for r in totals),
                sum(r.words for r in totals), tail_total, tail_distinct)


class Network:
    """The GRU; ``p`` holds its parameters: G (input to gates), U (state to gates), C and c (classes), W and w (words)."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, head: Head) -> Network:
        """Small random gates; outputs that begin as the unigram shares."""
        rng = np.random.default_rng(11)
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        shares = np.zeros(NEURAL)
        shares[:min(NEURAL, len(head.counts))] = head.counts[:NEURAL]
        return cls({"G": normal(NEURAL + CLASSES, 3 * HIDDEN), "U": normal(HIDDEN, 3 * HIDDEN), "C": normal(HIDDEN, CLASSES) * 0.1,
                    "c": np.log(head.mass + 0.5).astype(np.float32), "W": normal(NEURAL, HIDDEN) * 0.1,
                    "w": np.where(shares > 0, np.log(shares + 1e-9), -30).astype(np.float32)})

    def _forward(self, x: np.ndarray, h: np.ndarray, keep: bool, begins: np.ndarray | None):
        """States (HIDDEN + 1, steps, lanes), a row of ones last, so that output weights hold their own offsets; and with
        ``keep`` the states before, gates, candidates and sums that the way back needs. Lanes are the inner axis of all arrays."""
        k, (steps, lanes), one_half = HIDDEN, x.shape, np.float32(0.5)
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * k, k])[:, None]  # 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2
        gates, u = np.ascontiguousarray(self.p["G"].T, np.float32) * half, np.ascontiguousarray(self.p["U"].T, np.float32) * half
        out = np.empty((k + 1, steps, lanes), np.float32)
        out[k] = 1
        g, s, held = (np.empty((m * k, lanes), np.float32) for m in (3, 3, 1))
        zr, n = g[:2 * k], g[2 * k:]
        kept = tuple(np.empty((n, steps, lanes), np.float32) for n in (k, 2 * k, k, k)) if keep else ()
        h = np.ascontiguousarray(h.T, np.float32)
        fresh = begins.any(axis=1) if begins is not None else np.zeros(steps, bool)
        for t in range(steps):
            if fresh[t]:
                h = np.where(begins[t], np.float32(0), h)
            gates.take(x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=s)
            zr += s[:2 * k]
            np.tanh(zr, out=zr)
            zr *= one_half
            zr += one_half
            np.multiply(zr[k:], s[2 * k:], out=held)
            n += held
            np.tanh(n, out=n)
            if keep:
                kept[0][:, t], kept[1][:, t], kept[2][:, t], kept[3][:, t] = h, zr, n, s[2 * k:]
            np.subtract(h, n, out=held)
            held *= zr[:k]
            h = out[:k, t]
            np.add(held, n, out=h)
        return out, kept

    def states(self, x: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """States (steps, lanes, HIDDEN) after each step of inputs ``x`` (steps, lanes) from ``h``.
        Where ``begins`` (steps, lanes) holds, a text begins and the state before is zero."""
        return self._forward(x, h, False, begins)[0][:HIDDEN].transpose(1, 2, 0)

    def class_logits(self, h: np.ndarray) -> np.ndarray:
        return h @ self.p["C"] + self.p["c"]

    def _class_weights(self, dtype=np.float32) -> np.ndarray:
        return np.concatenate([self.p["C"].T, self.p["c"][:, None]], axis=1).astype(dtype)

    def _word_weights(self, dtype=np.float32) -> np.ndarray:
        return np.concatenate([self.p["W"], self.p["w"][:, None]], axis=1).astype(dtype)

    def log_probability(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log of P(class), and of P(word | class) where the word is one of the NEURAL (else -1)."""
        return self._log_p(np.concatenate([h.T, np.ones((1, len(h)), h.dtype)]), cls, word)

    def _log_p(self, ha: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        weights = self._class_weights(ha.dtype)
        logits = _in_range(weights @ ha, weights)
        out = logits[cls, np.arange(len(cls))]
        out -= np.log(np.exp(logits, out=logits).sum(axis=0))
        rows, inner, _, _ = self._inner(ha, word)
        own = inner[word[rows] % CLASS_WORDS, np.arange(len(rows))]
        out[rows] += own - np.log(np.exp(inner, out=inner).sum(axis=0))
        return out

    def _inner(self, ha: np.ndarray, word: np.ndarray):
        """Rows whose word has a vector, by class; logits of the words of each row's class (CLASS_WORDS, rows); the rows'
        states; and (class, from, to) of each class that has rows."""
        rows = np.flatnonzero(word >= 0)
        cls = (word[rows] // CLASS_WORDS).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        rows, cls = rows[order], cls[order]
        states, weights = ha.take(rows, axis=1), self._word_weights(ha.dtype)
        inner = np.empty((CLASS_WORDS, len(rows)), ha.dtype)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, int)
        parts = [(int(cls[i]), int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for c, i, j in parts:
            np.matmul(weights[c * CLASS_WORDS:(c + 1) * CLASS_WORDS], states[:, i:j], out=inner[:, i:j])
        return rows, _in_range(inner, weights), states, parts

    def gradients(self, x: np.ndarray, h: np.ndarray, cls: np.ndarray, word: np.ndarray, valid: np.ndarray,
                  begins: np.ndarray | None = None):
        """Gradients of the mean loss over one window, cut at its beginning and where a text begins, and the last state."""
        p, k, (steps, lanes) = self.p, HIDDEN, x.shape
        hs, (before, zr, cand, s) = self._forward(x, h, True, begins)
        flat, ok = hs.reshape(k + 1, -1), valid.ravel()
        cls, word = cls.ravel(), np.where(ok, word.ravel(), -1)
        n = np.float32(max(ok.sum(), 1))
        g = {name: np.zeros_like(v) for name, v in p.items()}
        weights = self._class_weights()
        d = _in_range(weights @ flat, weights)
        np.exp(d, out=d)
        d *= ok / (n * d.sum(axis=0))
        d[cls, np.arange(len(cls))] -= ok / n
        to = d @ flat.T
        g["C"], g["c"] = to[:, :k].T, to[:, k]
        dh = weights[:, :k].T @ d
        rows, e, states, parts = self._inner(flat, word)
        np.exp(e, out=e)
        e /= n * e.sum(axis=0)
        e[word[rows] % CLASS_WORDS, np.arange(len(rows))] -= 1 / n
        back = np.empty((k, len(rows)), np.float32)
        for c, i, j in parts:
            own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            to = e[:, i:j] @ states[:, i:j].T
            g["W"][own], g["w"][own] = to[:, :k], to[:, k]
            np.matmul(p["W"][own].T, e[:, i:j], out=back[:, i:j], casting="same_kind")
        dh[:, rows] += back
        dh = dh.reshape(k, steps, lanes)
        z, r = zr[:k], zr[k:]
        to_cand, to_z, to_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), s * r * (1 - r)
        gates = np.empty((3 * k, steps, lanes), np.float32)  # to the gates; the state's part of the last third is times r
        total, part, back = (np.empty((m * k, lanes), np.float32) for m in (1, 3, 1))
        back[:] = 0
        u = np.ascontiguousarray(p["U"], np.float32)
        stop = begins.any(axis=1) if begins is not None else np.zeros(steps, bool)
        for t in range(steps - 1, -1, -1):
            np.add(dh[:, t], back, out=total)
            dz, dr, dn = gates[:k, t], gates[k:2 * k, t], gates[2 * k:, t]
            np.multiply(total, to_cand[:, t], out=dn)
            np.multiply(total, to_z[:, t], out=dz)
            np.multiply(dn, to_r[:, t], out=dr)
            part[:2 * k] = gates[:2 * k, t]
            np.multiply(dn, r[:, t], out=part[2 * k:])
            np.matmul(u, part, out=back)
            total *= z[:, t]
            back += total
            if stop[t]:
                back[:, begins[t]] = 0
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        inputs, first = np.unique(x.ravel()[order], return_index=True)
        g["G"][inputs] = np.add.reduceat(gates.reshape(3 * k, -1).take(order, axis=1), first, axis=1).T
        gates[2 * k:] *= r
        g["U"] = before.reshape(k, -1) @ gates.reshape(3 * k, -1).T
        return g, hs[:k, -1].T


def _in_range(logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``logits`` whose exp stays inside single precision: states are within 1, so weights bound them; where these are
    too large, each column's largest is taken off."""
    if np.abs(weights).sum(axis=1).max(initial=0) > 60:
        logits -= logits.max(axis=0)
    return logits


class Lanes:
    """Whole documents dealt to lanes that are walked side by side in windows: the longest first, each to the shortest
    lane. State is carried from window to window, and is zero where a document begins; a lane at its end drops out."""

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray, head: Head, lanes: int):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        held: list[list[int]] = [[] for _ in range(min(lanes, len(lengths)))]
        short = [(0, i) for i in range(len(held))]
        for d in np.argsort(-lengths, kind="stable").tolist():
            size, lane = short[0]
            held[lane].append(d)
            heapq.heapreplace(short, (size + int(lengths[d]), lane))
        full = sorted(((sum(int(lengths[d]) for d in docs), docs) for docs in held), key=lambda x: -x[0])
        docs = np.array([d for _, of in full for d in of], int)
        sizes = lengths[docs]
        first = np.cumsum(sizes) - sizes  # of each document, in the order of lanes
        #: Places of the tokens in the order of lanes.
        self.places = np.arange(int(sizes.sum())) + np.repeat(starts[docs] - first, sizes)
        numbers = numbers[self.places]
        known = numbers >= 0
        at = np.where(known, numbers, 0)
        self.cls = np.where(known, head.cls[at], TAIL_CLASS - 1 - numbers).astype(np.int32)
        inp = np.where(known, head.inp[at], NEURAL + self.cls).astype(np.int32)
        self.word = np.where(known & (numbers < NEURAL), numbers, -1).astype(np.int32)
        self.own = np.where(known, head.own[at], 0).astype(np.float32)
        self.inp = np.empty_like(inp)
        self.inp[1:] = inp[:-1]
        self.inp[first] = 0  # a text begins after an end token
        self.begins = np.zeros(len(inp), bool)
        self.begins[first] = True
        sizes = np.array([n for n, _ in full])
        self.ends = np.cumsum(sizes)
        self.cur = self.ends - sizes
        self.h = np.zeros((len(sizes), HIDDEN), np.float32)

    def _at(self, steps: int):
        at = self.cur[None, :] + np.arange(min(steps, int((self.ends - self.cur).max())))[:, None]
        return np.minimum(at, self.ends - 1), at < self.ends

    def window(self, steps: int):
        """Inputs, classes, words, own shares and validity of the next steps of every lane."""
        at, valid = self._at(steps)
        return self.inp[at], self.cls[at], self.word[at], self.own[at], valid

    def advance(self, steps: int, h: np.ndarray) -> bool:
        """Move on; False when no lane is left."""
        self.cur = self.cur + steps
        left = self.cur < self.ends
        self.cur, self.ends, self.h = self.cur[left], self.ends[left], h[left]
        return bool(left.any())


def log_likelihoods(net: Network, head: Head, numbers: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Natural log-probability of each whole document, but for its tail words' shares of their classes."""
    if not len(lengths):
        return np.zeros(0)
    told = np.zeros(len(numbers))
    walk, going = Lanes(numbers, lengths, head, lanes), True
    while going:
        at, valid = walk._at(max(WINDOW, AT_ONCE // len(walk.cur)))
        hs, _ = net._forward(walk.inp[at], walk.h, False, walk.begins[at])
        lp = net._log_p(hs.reshape(HIDDEN + 1, -1), walk.cls[at].ravel(), np.where(valid, walk.word[at], -1).ravel())
        told[walk.places[at[valid]]] = lp.reshape(at.shape)[valid] + walk.own[at[valid]]
        going = walk.advance(len(at), hs[:HIDDEN, -1].T)
    return np.add.reduceat(told, np.cumsum(lengths) - lengths)


class Stream:
    """Pieces of texts one after the other, cut into lanes of one length that are walked side by side, so that a window
    has no padding. A lane that begins inside a piece has the state that the CONTEXT tokens before it give."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, leads: np.ndarray):
        n, starts = len(codes), np.cumsum(lengths) - lengths
        codes = codes.astype(np.int32)
        self.inp = np.empty_like(codes)
        self.inp[1:] = codes[:-1]
        self.inp[starts] = 0  # a text begins after an end token
        self.begins = np.zeros(n, bool)
        self.begins[starts] = True
        self.valid = np.arange(n) - np.repeat(starts, lengths) >= np.repeat(leads, lengths)
        self.cls = np.where(codes < NEURAL, codes // CLASS_WORDS, codes - NEURAL)
        self.word = np.where(codes < NEURAL, codes, -1)
        lanes = min(n, max(LEAST_LANES, min(TRAIN_LANES, n // (WINDOW * STEPS))))
        self.span = -(-n // lanes)
        self.at = np.arange(0, n, self.span)
        self.updates = -(-self.span // WINDOW)
        self.steps = -(-self.span // self.updates)

    def warm(self, net: Network) -> np.ndarray:
        """States of ``net`` before the first token of each lane."""
        at = np.maximum(self.at + np.arange(-CONTEXT, 0)[:, None], 0)
        return net.states(self.inp[at], np.zeros((len(self.at), HIDDEN), np.float32), self.begins[at])[-1]

    def window(self, i: int):
        """Inputs, classes, words, validity and beginnings of the ``i``-th steps of every lane."""
        step = np.arange(i * self.steps, min((i + 1) * self.steps, self.span))[:, None]
        at = self.at + step
        inside = at < len(self.inp)
        at = np.minimum(at, len(self.inp) - 1)
        return self.inp[at], self.cls[at], self.word[at], self.valid[at] & inside, self.begins[at]


def codes_of(head: Head, numbers: np.ndarray) -> np.ndarray:
    """What the network knows of words by number: one of the NEURAL, or NEURAL and the class."""
    known = numbers >= 0
    return np.where(known, head.inp[np.where(known, numbers, 0)], NEURAL + TAIL_CLASS - 1 - numbers).astype(np.uint16)


def train_codes(net: Network, codes: np.ndarray, lengths: np.ndarray, leads: np.ndarray, updates: int | None, rate: float) -> Network:
    """One pass of truncated backpropagation (Adam) over all pieces, or its first ``updates`` windows where that is asked."""
    p = {k: v.copy() for k, v in net.p.items()}
    own = Network(p)
    if not len(codes):
        return own
    walk = Stream(codes, lengths, leads)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    n = walk.updates if updates is None else min(updates, walk.updates)
    h = walk.warm(net)
    for step in range(1, n + 1):
        x, cls, word, valid, begins = walk.window(step - 1)
        g, h = own.gradients(x, h, cls, word, valid, begins)
        norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
        cut = min(1.0, 1.0 / max(norm, 1e-9))
        pace = rate * (1 - 0.9 * step / n) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        for k, d in g.items():
            d *= np.float32(cut)
            m[k] += np.float32(0.1) * (d - m[k])
            v[k] += np.float32(0.01) * (d * d - v[k])
            p[k] -= np.float32(pace) * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))
    return own


def train_copy(net: Network, head: Head, numbers: np.ndarray, lengths: np.ndarray, updates: int | None, rate: float, seed: int) -> Network:
    """:func:`train_codes` over whole documents of numbered words, in an order by ``seed``."""
    order = np.random.default_rng(seed).permutation(len(lengths))
    starts = np.cumsum(lengths) - lengths
    numbers = np.concatenate([numbers[starts[i]:starts[i] + lengths[i]] for i in order] or [numbers])
    return train_codes(net, codes_of(head, numbers), lengths[order], np.zeros(len(lengths), np.int64), updates, rate)


def _numbers(table: dict, texts: list) -> tuple[np.ndarray, np.ndarray]:
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.int32, int(lengths.sum())), lengths


def _blocks(batches, number: _Numbers):
    """Of each coded block of Arrow batches: the row, the documents' sizes, places in the block's words and numbers of all
    tokens. Each word of a block is looked up once."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            places = np.frombuffer(row.column("codes")[0].as_buffer(), np.int32)
            words = row.column("words")[0].values
            numbers = np.fromiter(map(number.__getitem__, words.to_pylist()), np.int32, len(words))
            yield row, row.column("sizes")[0].values.to_numpy(), places, numbers[places]


def pieces_of(blocks: DataFrame, shared, groups: int) -> DataFrame:
    """``g int, lead int, codes binary`` of every token to learn from in coded blocks: texts in pieces of at most PIECE
    tokens (16-bit codes), each after the ``lead`` tokens before it, dealt to ``groups`` by a hash of the piece, the
    document's place in its block and the block's number, so that null texts, null keys and copies go to all groups."""
    def run(batches):
        for row, sizes, _, flat in _blocks(batches, shared.value.number):
            codes, ends = codes_of(shared.value, flat), np.cumsum(sizes)
            learn = np.flatnonzero(row.column("learn")[0].values.to_numpy(zero_copy_only=False)).tolist()
            made = [(i, k, max(a - CONTEXT, start), a, min(a + PIECE, end)) for i, start, end in ((i, int(ends[i] - sizes[i]), int(ends[i])) for i in learn)
                    for k, a in enumerate(range(start, end, PIECE))]
            for at in range(0, len(made), 1024):
                part = made[at:at + 1024]
                yield pa.RecordBatch.from_arrays([
                    row.column("block").take(pa.array(np.zeros(len(part), np.int64))), pa.array([i for i, *_ in part], pa.int32()),
                    pa.array([k for _, k, *_ in part], pa.int32()), pa.array([a - b for _, _, b, a, _ in part], pa.int32()),
                    pa.array([codes[b:c].tobytes() for _, _, b, _, c in part], pa.binary())], names=["block", "i", "k", "lead", "codes"])
    cut = blocks.select("block", "learn", "sizes", "codes", "words").mapInArrow(run, "block long, i int, k int, lead int, codes binary")
    return cut.select(F.pmod(F.xxhash64("block", "i", "k"), F.lit(groups)).cast("int").alias("g"), "lead", "codes")


def pieces(learned: DataFrame, head: Head, shared, groups: int) -> DataFrame:
    """:func:`pieces_of` over all texts of column ``t`` (binary)."""
    return pieces_of(coded(learned, F.lit(True), [c for c in learned.columns if c != "t"], "t"), shared, groups)


def _copy(held, updates: int | None, k: int):
    """Group map of round ``k``: the pieces of one group -> its trained parameters."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("codes").to_pylist(), table.column("lead").to_pylist(), strict=True))
        rows = [rows[i] for i in np.random.default_rng(k).permutation(len(rows))]
        codes, leads = np.frombuffer(b"".join(c for c, _ in rows), np.uint16), np.array([x for _, x in rows])
        got = train_codes(Network(held.value), codes, np.array([len(c) // 2 for c, _ in rows]), leads, updates, RATE * 0.7 ** k)
        data = np.concatenate([got.p[n].ravel() for n in sorted(got.p)]).astype(np.float32).tobytes()
        return pa.table({"n": pa.array([len(codes) - int(leads.sum())], pa.int64()), "p": pa.array([data], pa.binary())})
    return run


def mean_of(copies: DataFrame) -> tuple[int, np.ndarray | None]:
    """Tokens ``n`` of all copies, and the mean of their parameters ``p`` by tokens. Tasks add up their copies and the
    sums are added in tasks again, so the driver gets about the square root of the partitions of them."""
    def add(total, row):
        mine = np.frombuffer(bytes(row.p), np.float32).astype(float) * row.n
        return total[0] + row.n, mine if total[1] is None else total[1] + mine

    def both(a, b):
        return a[0] + b[0], b[1] if a[1] is None else a[1] if b[1] is None else a[1] + b[1]
    n, whole = copies.rdd.treeAggregate((0, None), add, both)
    return n, whole / n if n else None


def train(blocks: DataFrame, head: Head, shared, rounds: int = ROUNDS, updates: int | None = None) -> Network:
    """One pass over every document to learn from in coded ``blocks``, a share of the groups in each round. A group's copy
    sends its parameters, 0.4 MB, on to be averaged by tokens. ``updates`` bounds the windows of a group, for callers
    who want less than all."""
    spark = blocks.sparkSession
    net = Network.fresh(head)
    groups = rounds * max(1, -(-int(head.total) // (GROUP * max(rounds, 1))))
    dealt = written(pieces_of(blocks, shared, max(groups, 1)), "lm-pieces")
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.BinaryType())])
    for k in range(rounds):
        held = spark.sparkContext.broadcast(net.p)
        _, mean = mean_of(dealt.where(F.col("g") % rounds == k).groupBy("g").applyInArrow(_copy(held, updates, k), out))
        if mean is None:
            continue
        at = 0
        for name in sorted(net.p):
            shape = net.p[name].shape
            size = int(np.prod(shape))
            net.p[name] = mean[at:at + size].reshape(shape).astype(np.float32)
            at += size
    return net


_SCORED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()),
                        T.StructField("lp", T.DoubleType()), T.StructField("tail", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType()))])


def _score(shared, params):
    """Arrow map of coded blocks (key, sizes, codes, words) -> (key, fields of _SCORED), a row a document."""
    def run(batches):
        head, net = shared.value, Network(params.value)

        def scored(keys, flats, sizes, tails):
            flat, size = np.concatenate(flats), np.concatenate(sizes)
            starts = np.cumsum(size) - size
            known = flat >= 0
            at = np.where(known, flat, 0)
            base = np.add.reduceat(np.where(known, head.base[at], 0), starts)
            seen = np.add.reduceat((known & (head.counts[at] > 0)).astype(np.int64), starts)
            made = [pa.array(size), pa.array(seen), pa.array(base), pa.array(log_likelihoods(net, head, flat, size))]
            made += [pa.concat_arrays(column) for column in zip(*tails, strict=True)]
            yield from pa.table([pa.concat_arrays(keys), *made], names=["key", *_SCORED.names]).to_batches(1024)

        keys, flats, sizes, tails, held = [], [], [], [], 0
        for row, size, places, flat in _blocks(batches, head.number):
            keys.append(row.column("key")[0].values)
            flats.append(flat)
            sizes.append(size)
            tails.append(_tails(row.column("words")[0].values, size, places, flat))
            held += len(flat)
            if held >= HELD_TOKENS:
                yield from scored(keys, flats, sizes, tails)
                keys, flats, sizes, tails, held = [], [], [], [], 0
        if keys:
            yield from scored(keys, flats, sizes, tails)
    return run


def _tails(words: pa.Array, sizes: np.ndarray, places: np.ndarray, flat: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """By document: its distinct words beyond the head, and how often it has each."""
    beyond = np.flatnonzero(flat < 0)
    doc = np.searchsorted(np.cumsum(sizes), beyond, side="right")
    pairs, times = np.unique(doc * np.int64(max(len(words), 1)) + places[beyond], return_counts=True)
    doc, place = np.divmod(pairs, max(len(words), 1))
    cuts = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(cuts, words.take(pa.array(place))),
            pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))))


def score(df: DataFrame, learn: Column, key: list[str], text: str = "text", rounds: int = ROUNDS,
          updates: int | None = None) -> DataFrame:
    """One row per row of ``df``: the ``key`` columns, ``n_tokens, n_known, train_tokens, base_score, score``.

    ``learn``: which rows to learn from. Counts cover all of them, and the network is trained on all of them, each
    token once (or the first ``updates`` windows of each group, if that is asked). Scores are log10; a null text is the empty text, which has the end token
    alone. Repeated rows are scored each. Without any row to learn from, every word is unseen and the network is
    untrained. An empty table gives an empty result; other columns are ignored.

    Words beyond the head leave the scoring task as (row, word, times), meet the count table in a join and are summed
    by row; nothing that grows with the vocabulary is broadcast or collected."""
    spark = df.sparkSession
    ship_package(spark)
    blocks = written(coded(df, learn, key, text), "lm-blocks", **BLOCK_FILES)
    counts = written(counts_of(blocks), "counts")
    head = learn_head(counts)
    shared = spark.sparkContext.broadcast(head)
    net = train(blocks, head, shared, rounds, updates)
    params = spark.sparkContext.broadcast(net.p)
    schema = T.StructType([T.StructField("key", blocks.schema["key"].dataType.elementType), *_SCORED])
    made = blocks.select("key", "sizes", "codes", "words").mapInArrow(_score(shared, params), schema)
    scored = written(made.withColumn("__row", F.monotonically_increasing_id()), "scored")
    tails = scored.select("__row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("__row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    met = tails.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    mass = F.array(*[F.lit(float(t + SMOOTH * (d + 1))) for t, d in zip(head.tail_total, head.tail_distinct, strict=True)])
    ten = F.log10(F.col("c") + SMOOTH)
    sums = met.groupBy("__row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * (ten - float(np.log10(head.denominator)))).alias("tail_base"),
        F.sum(F.col("times") * (ten - F.log10(F.get(mass, ending(F.col("word")))))).alias("tail_lp"))
    return scored.join(sums, "__row", "left").select(
        *[F.col(f"key.`{k}`") for k in key], "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("lp") / float(np.log(10)) + F.coalesce("tail_lp", F.lit(0.0))).alias("score"))
