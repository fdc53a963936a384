"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

Words are merged by a priority queue of merge ranks over a doubly linked symbol list: the best pair is popped,
skipped if one of its symbols has gone or changed since it was queued (a stale entry), else joined, and its two
new neighbours are queued. Decoding concatenates vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from webloom.llm.common import columns_without, map_values, quoted
from webloom.session import bound_batches, ship_package

#: Bytes of words and their encodings that a Python worker remembers; the memory is emptied when full.
CACHE_BYTES = 128 << 20
#: Bytes of text, at most, whose ids and strings a Python worker holds at once (one text may be longer).
SLICE_BYTES = 4 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(others)) for b in range(256)]


class Bpe:
    """A tokenizer file of kind BPE with an end-of-word mark: normaliser, word pattern, byte symbols and merges are
    read from the file; anything in it that this class doesn't implement is refused."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("unsupported model")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        #: (left id << 32 | right id) -> rank << 32 | joined id
        self.merges = {self.ids[a] << 32 | self.ids[b]: rank << 32 | self.ids[a + b] for rank, (a, b) in enumerate(merges)}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or bytes_["type"] != "ByteLevel":
            raise ValueError("unsupported normaliser or word pattern")
        # the file's \s is Unicode White_Space, which regex spells as a property
        self.spaces = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.space = spec["normalizer"]["normalizers"][1]["content"]
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.symbols = byte_symbols()
        self.first = [self.ids[c] for c in self.symbols]
        self.last = [self.ids[c + self.suffix] for c in self.symbols]
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        self.known: dict[str, tuple] = {}
        self.known_bytes = 0
        self.compare = True
        self.memory: int | None = None  # bytes of words remembered, CACHE_BYTES if not given

    def normalised(self, text: str) -> str:
        text = self.spaces.sub(self.space, unicodedata.normalize("NFC", text))
        if text.isascii():
            return text.lower()
        # character by character: the lower case of a capital sigma doesn't depend on its place in the word
        return text.replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode("utf-8")
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges, queue = self.merges, []
        for i in range(n - 1):
            pair = ids[i] << 32 | ids[i + 1]
            if found := merges.get(pair):
                queue.append((found >> 32, i, pair, found & 0xFFFFFFFF))
        heapq.heapify(queue)
        while queue:
            _, i, pair, new = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] << 32 | ids[j] != pair:
                continue  # stale: a symbol was merged away since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get(pair := new << 32 | ids[k]):
                    heapq.heappush(queue, (found >> 32, i, pair, found & 0xFFFFFFFF))
            h = before[i]
            if h >= 0 and (found := merges.get(pair := ids[h] << 32 | new)):
                heapq.heappush(queue, (found >> 32, h, pair, found & 0xFFFFFFFF))
        return [x for x in ids if x >= 0]

    def spell(self, word: str) -> tuple:
        """``ids as bytes, ids as text, decoded strings``, and with ``compare`` whether these strings spell the word. The
        ids come first, all else is read from them."""
        ids = self.merge(word)
        decoded = self.decode(ids)
        return array("i", ids).tobytes(), " ".join(map(str, ids)), decoded, not self.compare or self.told_by(decoded) == word + " "

    def spelled(self, text: str) -> list[tuple]:
        """:meth:`spell` of each word and special token of a text, each distinct word's from a memory of bounded size."""
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                token = self.added[part]
                out.append((array("i", [token]).tobytes(), str(token), part, True))
                continue
            words = self.word.findall(self.normalised(part)) if part else []
            known = self.known
            for w in set(words).difference(known):
                if self.known_bytes > (self.memory or CACHE_BYTES):
                    known, self.known_bytes = {}, 0
                    self.known = known
                got = known[w] = self.spell(w)
                self.known_bytes += 400 + len(w) * 4 + 5 * len(got[0])
            try:
                out += [known[w] for w in words]
            except KeyError:  # the memory was emptied on the way
                out += [known.get(w) or self.spell(w) for w in words]
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join([w[0] for w in self.spelled(text)])).tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a space between them; ids outside the vocabulary are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def told_by(self, decoded: str) -> str:
        """The words that vocabulary strings spell, each followed by a space, special tokens by none."""
        out = bytearray()
        for s in decoded.split(" ") if decoded else ():
            if s in self.added:
                out += s.encode()
                continue
            ends = bool(self.suffix) and s.endswith(self.suffix)
            out += bytes(self.bytes_of[c] for c in (s[:-len(self.suffix)] if ends else s))
            out += b" " * ends
        return out.decode("utf-8", "replace")

    def told(self, text: str) -> str:
        """What :meth:`told_by` must give for the ids of ``text``: its normalised words and special tokens."""
        return "".join(part if k % 2 else "".join(w + " " for w in self.word.findall(self.normalised(part)))
                       for k, part in enumerate(self.special.split(text)))


_LOADED: dict[int, Bpe] = {}


def _loaded(shared) -> Bpe:
    source = shared.value
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


def _shared(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent to each executor once: a file of fixed size (1.7 MB)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for row, n in enumerate(sizes.tolist()):
        if size + n > SLICE_BYTES and row > at:
            yield batch.slice(at, row - at)
            at, size = row, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def coded(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
          columns: tuple[str, ...] = ("ids", "n_tokens", "decoded", "round_trip"), memory: int | None = None) -> DataFrame:
    """Adds, of these, the named columns: ``ids array<int>``, ``n_tokens long``, ``decoded string`` (the vocabulary strings of the
    ids, joined by single spaces), ``round_trip boolean`` (whether these spell the text's normalised words and special
    tokens, all in their order), ``ids_sha256`` and ``decoded_sha256`` (hex digests of the decimal ids joined by a space, and of ``decoded``).

    One Arrow map over slices of bounded text: each distinct word is encoded once, its ids are decoded and compared with
    it, and whole texts are joined from that; ``memory`` bounds the bytes of words a Python worker remembers. ``path``: the tokenizer file, on the driver. A null text is the empty text,
    which has no ids, an empty ``decoded`` and makes the round trip; special tokens spelled in a text become their ids. Texts are
    never cut. Repeated rows and ids are rows of their own, an empty table gives none. Columns of ``df`` named like an
    added one are replaced; all others stay (or those in ``keep``)."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    shared = _shared(df, path)
    types = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.StringType(), "round_trip": T.BooleanType(),
             "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    wanted = df.columns if keep is None else keep
    kept = [c for c in wanted if c in columns_without(df, columns)]
    src = df.select(*[quoted(c) for c in kept], F.coalesce(quoted(text).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([src.schema[c] for c in kept] + [T.StructField(c, types[c]) for c in columns])
    fields = [to_arrow_schema(schema).field(c) for c in columns]

    def ids_of(texts):
        codes = [b"".join([w[0] for w in words]) for words in texts]
        offsets = np.cumsum([0, *(len(c) // 4 for c in codes)], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<i4")))

    makers = {
        "ids": ids_of,
        "n_tokens": lambda texts: [sum([len(w[0]) for w in words]) // 4 for words in texts],
        "decoded": lambda texts: [" ".join([w[2] for w in words]) for words in texts],
        "round_trip": lambda texts: [all([w[3] for w in words]) for words in texts],
        "ids_sha256": lambda texts: [hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest() for words in texts],
        "decoded_sha256": lambda texts: [hashlib.sha256(" ".join([w[2] for w in words]).encode()).hexdigest() for words in texts],
    }

    def run(batches):
        bpe = _loaded(shared)
        if bpe.compare != ("round_trip" in columns):
            bpe.compare, bpe.known, bpe.known_bytes = "round_trip" in columns, {}, 0
        bpe.memory = memory
        for batch in batches:
            for part in _slices(batch, len(kept)):
                texts = [bpe.spelled(t) for t in part.column(len(kept)).to_pylist()]
                made = [makers[f.name](texts) for f in fields]
                made = [m.cast(f.type) if isinstance(m, pa.Array) else pa.array(m, f.type) for m, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)
    return src.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids array<int>`` and ``n_tokens long`` to every row of ``df``; cases as in :func:`coded`."""
    return coded(df, path, text, keep, ("ids", "n_tokens"))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded string``: the vocabulary strings of ``ids`` (null: none), concatenated with single spaces. Ids outside the
    vocabulary are left out, repeated rows stay, an empty table gives no rows, a column named ``decoded`` is replaced."""
    shared = _shared(df, path)
    out = T.StructType([T.StructField("decoded", T.StringType())])

    def start():
        bpe = _loaded(shared)
        return lambda rows: [[bpe.decode(r or []) for r in rows]]
    return map_values(df, F.col(f"`{ids}`"), out, start, df.columns if keep is None else keep)


def round_trip(df: DataFrame, path: str, text: str = "text", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``round_trip boolean``: whether ``decoded`` spells the normalised words and special tokens of ``text``, all
    of them in their order. A null is the empty text."""
    shared = _shared(df, path)
    out = T.StructType([T.StructField("round_trip", T.BooleanType())])

    def start():
        bpe = _loaded(shared)
        return lambda rows: [[bpe.told_by(r["d"] or "") == bpe.told(r["t"] or "") for r in rows]]
    value = F.struct(F.col(f"`{text}`").alias("t"), F.col(f"`{decoded}`").alias("d"))
    return map_values(df, value, out, start, df.columns if keep is None else keep)


def digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens, ids_sha256, decoded_sha256``: what :func:`encode` and then :func:`decode` give, digested in
    the task that encodes; cases as in :func:`coded`."""
    return coded(df, path, text, keep, ("n_tokens", "ids_sha256", "decoded_sha256"), memory=2 * CACHE_BYTES)
