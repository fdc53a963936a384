from pyspark.sql import functions as F

from webloom.functions import text as TX
from webloom.operators.fit import chunk_text, fit_text


def one(spark, col, s):
    return spark.createDataFrame([(s,)], "s string").select(col(F.col("s")).alias("v")).collect()[0].v


def test_clean_markdown(spark):
    out = one(spark, TX.clean_markdown, "a\n\n\n\n\nb  c   \n[](http://x)\n![i](p.png)\ncats")
    assert "\n\n\n\n" not in out and "[](" not in out and "![i]" not in out and "b c" in out and "cats" in out


def test_fit_text(spark):
    md = "A" * 5 + "\n\n" + "B" * 5 + "\n\n" + "C" * 5 + "\n\n" + "D" * 5
    out = one(spark, lambda c: fit_text(c, "a", 10), md)
    assert len(out) <= 13
    cats = "cats are great\n\ndogs bark\n\nmore about cats"
    out = one(spark, lambda c: fit_text(c, "cats", None), cats)
    assert out.startswith("cats are great\n\nmore about cats")
    assert one(spark, lambda c: fit_text(c, None, 4), "abcdefgh") == "abcd..."


def test_truncate_and_chunks(spark):
    s = ("word. " * 20)
    out = one(spark, lambda c: TX.truncate_tokens(c, 5), s)
    assert out.endswith("[Content truncated...]") and out.startswith("word. word. word.")
    df = spark.createDataFrame([(1, "x" * 50)], "id long, text string")
    rows = chunk_text(df, "text", threshold=5, overlap=1, keep=["id"]).collect()
    assert [(r.start, len(r.chunk)) for r in rows] == [(0, 20), (16, 20), (32, 18), (48, 2)]


def test_numbers(spark):
    assert one(spark, lambda c: TX.parse_number(c), "$1,234.50 each") == 1234.5
    assert one(spark, lambda c: TX.parse_number(c, -1.0), "none") == -1.0
    assert one(spark, TX.cell_number, "1,234") == 1234.0
    assert one(spark, TX.cell_number, "abc") is None
    assert int(one(spark, TX.cell_integer, " 9,007,199,254,740,993 ")) == 9007199254740993
    assert one(spark, TX.cell_integer, "1.5") is None and one(spark, TX.cell_number, "99999999999999999999") == 1e20


def test_query_words_and_diff(spark):
    assert sorted(one(spark, TX.query_words, "  Cats  cats DOGS ")) == ["cats", "dogs"]
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nx")], "o string, n string")
    assert df.select(TX.diff_summary("o", "n")).collect()[0][0] == "+2 lines added, -1 lines removed"
