"""The pipeline: each stage against a plain version on its own input, and the whole on odd rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from webloom.llm import pii
from webloom.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage_keeps_what_has_letters(spark, docs):
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 !", None, "s", 4), (-3, "der und", None, None, None)], SCHEMA)
    kept = cp.language_id(spark, docs.unionByName(odd), SF)
    assert kept.columns == docs.columns
    got = rows(kept)
    assert set(got) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {-3} and got[-3].lang in ("en", "de", "fr", "es")


def test_near_dedup_stage_keeps_one_of_each_class(spark, docs):
    from test_simhash import brute_components
    odd = spark.createDataFrame([(None, "x y z q", "en", "s", 7), (None, "x y z q", "en", "s", 7), (-5, "X y z q", None, None, None),
                                 (-5, "X  y z q", None, None, None), (None, None, None, None, None), (None, "a b c d e", "en", "s", 9)], SCHEMA)
    both = docs.unionByName(odd)
    kept = cp.near_dedup(spark, both, SF)
    assert kept.columns == docs.columns
    fp = {tuple(r): fingerprint((r.text or "").encode(), 4) for r in both.collect()}
    roots = brute_components(set(fp.values()), 4)
    best = {}
    for r, f in fp.items():
        best[roots[f]] = min(best.get(roots[f], (True, 0)), (r[0] is None, r[0] or 0))
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(best) == len(set(got))
    assert sorted(((r[0] is None, r[0] or 0) for r in got)) == sorted(best.values())
    assert {roots[fp[r]] for r in got} == set(best)


def test_personal_data_stage(spark, docs):
    out, before = rows(cp.personal_data(spark, docs, SF)), rows(docs)
    anchors = pii.automaton()
    assert set(out) == set(before)
    for d, r in out.items():
        assert r.text == pii.redacted(before[d].text, pii.find_spans(anchors, before[d].text)) and r.n_chars == len(r.text)
        assert not pii.find_spans(anchors, r.text)


def test_mix_stage(spark, docs):
    out = cp.source_mix(spark, docs, SF)
    assert out.columns == docs.columns
    before = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= before and abs(len(got) - len(before)) < 5 * len(before) ** 0.5


def test_tokens_stage(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = rows(docs)
    for d, r in rows(cp.tokens(spark, docs, SF)).items():
        assert r.ids == t.encode(before[d].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 50 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_empty_table(spark, docs):
    d = docs.limit(0)
    for _, stage in cp.STAGES:
        d = stage(spark, d, SF)
        assert d.count() == 0


def test_extra_columns(spark, docs):
    d = docs.limit(30).select("*", F.lit(1).alias("fp"), F.lit("x").alias("lang_pred"), F.lit(2).alias("ids"), F.lit(3).alias("copy"), F.lit(4).alias("component"))
    for _, stage in cp.STAGES:
        assert stage(spark, d, SF).count() >= 0


def test_tokens_stage_decodes(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "Ünïted  a<|endoftext|>b </w> 12\n😀 的", None, "s", 4)], SCHEMA)
    for r in cp.tokens(spark, docs.unionByName(odd), SF).collect():
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False) and r.round_trip


def test_round_trip_tells_a_lost_token(spark):
    from webloom.llm import bpe
    df = spark.createDataFrame([("one two", "one</w>"), ("one two", "one</w> two</w>"), ("one two", "two</w> one</w>"), (None, None)], "text string, decoded string")
    rows = bpe.round_trip(df, cp.TOKENIZER).collect()
    assert [r.round_trip for r in rows] == [False, True, False, True]


def test_mix_draws_rows_of_one_key_apart(spark):
    """A third of rows without doc_id, a third equal rows: each is drawn by itself, and shares are met."""
    odd = spark.createDataFrame([(None, f"text {i}", "en", "hot", 6) for i in range(1000)] + [(7, "same", "en", "hot", 4)] * 1000
                                + [(100 + i, f"t{i}", "en", "cold", 3) for i in range(100)], SCHEMA)
    got = [r.text for r in cp.source_mix(spark, odd, SF).collect()]
    hot = 2100 * 2000 ** 0.5 / (2000 ** 0.5 + 100 ** 0.5) / 2000
    null = [t for t in got if t.startswith("text")]
    assert abs(len(null) - 1000 * hot) < 130 and 400 < len(set(null)) < 650 and abs(got.count("same") - 1000 * hot) < 130
    assert sorted(got) == sorted(r.text for r in cp.source_mix(spark, odd.repartition(3), SF).collect())
