"""Language id: held-out accuracy, hierarchy, defined cases."""

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import language
from webloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = QUERIES["op1_language"](spark, sf).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 250
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_family_then_duel():
    rng = np.random.default_rng(0)
    words = {"en": "the and of with that", "de": "der und von mit dass", "fr": "le et des avec que", "xx": "qoq zuz kwk vyv jij"}
    rows = [(lang, language.features(" ".join(rng.choice(w.split(), 20)))) for lang, w in words.items() for _ in range(15)]
    m = language.train(rows)
    assert m.families == ["germanic", "own:xx", "romance"] and list(m.pair_weights) == [("de", "en")]
    for lang, w in words.items():
        assert m.predict(w)[0] == lang
    assert language.train(rows).family_weights.tolist() == m.family_weights.tolist()


def test_features():
    assert language.features("12 !?") is None and language.features("") is None
    one, two = language.features("Ab, cd! "), language.features("ab 12 CD")
    assert np.allclose(one, two) and abs(np.linalg.norm(one) - 1) < 1e-9
    assert language.features("é" * (language.PIECE + 5)) is not None


def test_svm_separates():
    x = np.array([[0.0, 1], [0, 2], [1, 0], [2, 0]])
    y = np.array([1.0, 1, -1, -1])
    w = language.fit_svm(x, y)
    assert all(np.sign(np.hstack([x, np.ones((4, 1))]) @ w) == y)


def test_defined_cases(spark):
    text = {"en": "the and of with that ", "de": "der und von mit dass "}
    rows = [(i, t * (i + 1), lang, 0.5) for lang, t in text.items() for i in range(8)] + [(None, None, "en", 0.1), (1, "", None, 0.1), (2, "12 34", "fr", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(language.training_rows(df))
    assert sorted({lang for lang in sum(model.languages.values(), [])}) == ["de", "en"]
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out.collect() if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred == r.lang for r in out.collect() if r.lang_pred != "und")
    # one language, no language, no rows
    single = language.train(language.training_rows(df.where("lang = 'de'")))
    assert {r.lang_pred for r in language.identify(df, single).collect()} == {"de", "und"}
    none = language.train(language.training_rows(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in language.identify(df, none).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), model).count() == 0


def test_sample_is_bounded_and_counts_copies_once(spark):
    df = spark.createDataFrame([("the same", "en")] * 50 + [(f"word {chr(97 + i % 26)}{i} x", "en") for i in range(30)], "text string, lang string")
    assert len(language.training_rows(df, per_language=7)) == 7 and len(language.training_rows(df)) == 31


def test_many_languages_are_all_learned(spark):
    """200 languages with a word of their own each; every one can be predicted, with or without tasks that fit."""
    def word(i):
        return "".join(chr(97 + (i * 7 + k * k * (i % 11 + 3)) % 26) for k in range(9))
    rows = [(f"{word(i)} {word(i)} {chr(98 + k)}", f"x{i}" if i else "en") for i in range(200) for k in range(3)] + [("das wort", "de"), ("le mot", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    sample = language.training_rows(df, per_language=3)
    assert len({lang for lang, _ in sample}) == 202 and len(sample) == 602
    model = language.train(sample, spark)
    plain = language.train(sample)
    assert model.families == plain.families and np.array_equal(model.family_weights, plain.family_weights)
    assert list(model.pair_weights) == [("de", "en")] and np.array_equal(model.pair_weights["de", "en"], plain.pair_weights["de", "en"])
    told = [model.predict(t)[0] == lang for t, lang in rows]
    assert sum(told) / len(told) > 0.95
    assert len(language.training_rows(df, per_language=3, total=404)) == 602 - 0  # at least 5 each, so all of 3
    assert len({lang for lang, _ in language.training_rows(df, total=10)}) == 202


def test_features_of_long_texts_run_on(monkeypatch):
    text = "Ein langes Wort, und noch eines!  12 " * 7 + "é"
    whole = language.features(text)
    for piece in (1, 2, 3, 5, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.array_equal(language.features(text), whole)


def test_a_separator_is_fitted_in_the_memory_of_one_row():
    """Examples stay sparse: spread out together, these 400 rows take 26 MB, and three times that while they are prepared."""
    import tracemalloc
    rng = np.random.default_rng(3)
    y = np.array(["de", "en"] * 200)
    rows = [(np.sort(rng.choice(language.BUCKETS, 50, replace=False)).astype(np.int32), rng.random(50).astype(np.float32)) for _ in y]
    tracemalloc.start()
    w = language._fit(("pair", "de", "en"), y, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.zeros((len(y), language.BUCKETS))
    for i, (used, values) in enumerate(rows):
        x[i, used] = values
    assert peak < 4e6, peak
    assert np.array_equal(w, language.fit_svm(x, np.where(y == "de", 1.0, -1.0)).astype(np.float32))
