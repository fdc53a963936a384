"""BPE against the tokenizers library, exact round trip, defined cases."""

import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webloom.llm import bpe
from webloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want, repr(text)
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_random_texts(own, library):
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "\x85", "\x1c", "　", "​", "'s", "'LL", "Σ", "ΑΣ", "İ", "ﬁ", "é", "é",
             "Å", "Ⅷ", "1", "²", "的", "😀", "-", "'", "Th", "a", "ing"]
    for _ in range(4000):
        same(own, library, "".join(rng.choices(parts, k=rng.randint(0, 25))))


def test_long_word_and_special_cases(own, library):
    for text in ("", " ", "a" * 30_000, "ab" * 5000 + "<|endoftext|>" * 3, "x" * 5 + "é" * 999):
        same(own, library, text)


def test_memory_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    own.known, own.known_bytes = {}, 0
    same(own, library, "one two three four five six one two seven")
    assert len(own.known) <= 3


def test_slices_are_bounded_by_bytes(spark, library, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 95, "c" * 300, "", "d"])], names=["t"])
    monkeypatch.setattr(bpe, "SLICE_BYTES", 100)
    assert [p.num_rows for p in bpe._slices(batch, 0)] == [2, 1, 1, 2]


def test_coded(spark, library):
    df = spark.createDataFrame([(1, "Ünïted  a<|endoftext|>b </w> 12\n😀 的", 7), (None, None, 7), (2, "", 7), (2, "", 7)], "doc_id long, text string, ids long")
    out = bpe.coded(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded", "round_trip"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False) and r.round_trip


def test_whole_table(spark, library):
    import hashlib
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, sf).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 7), (None, "", 7), (2, "the cat", 7), (2, "the cat", 7)], "doc_id long, text string, ids long")
    out = bpe.encode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    rows = out.collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    back = bpe.decode(out, PATH).collect()
    assert sorted(r.decoded for r in back) == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert bpe.encode(df.limit(0), PATH).count() == 0
