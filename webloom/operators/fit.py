"""Query-focused fitting of Markdown/text (F10, F12, W1, O2, O7) and chunking.

``fit_text`` works inside each row (array sort + fold over the row's paragraphs): no shuffle, no
window, bounded by the document itself.  ``within_budget`` is the same budget rule as a window over
a long paragraph table, for paragraphs that already live in rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.common import col as _c
from webloom.functions.text import chunk_starts, cut, match_count, query_words
from webloom.operators.matching import pattern_scores


def fit_text(md, query: str | None, max_length: int | None = None, sep: str = "\n\n", top: int = 10) -> Column:
    """no query -> O7 cut; else paragraphs scored by query-word matches, sorted by score desc
    (ties in text order), then the length budget (W1) or the top ``top`` (O2), joined by ``sep``."""
    md = _c(md)
    if not query:
        return cut(md, max_length) if max_length else md
    words = query_words(F.lit(query))
    paras = F.split(md, re.escape(sep), -1)
    scored = F.transform(paras, lambda p, i: F.struct(
        (-match_count(words, F.lower(p))).alias("neg"), i.alias("i"), p.alias("p")))
    ordered = F.array_sort(scored)
    if not max_length:
        return F.array_join(F.transform(F.slice(ordered, 1, top), lambda s: s["p"]), sep)
    init = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("stop"),
                    F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        n = F.length(s["p"])
        over = acc["stop"] | (acc["used"] + n > max_length)
        return F.struct(F.when(over, acc["used"]).otherwise(acc["used"] + n + 2).alias("used"), over.alias("stop"),
                        F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(s["p"]))).alias("out"))
    return F.array_join(F.aggregate(ordered, init, step)["out"], sep)


def paragraph_table(docs: DataFrame, key: str, text: str, query: str, sep: str = "\n\n") -> DataFrame:
    """F10 + F7: one row per paragraph with its score."""
    words = query_words(F.lit(query))
    p = docs.select(key, F.posexplode(F.split(text, re.escape(sep), -1)).alias("pos", "para"))
    return p.withColumn("score", match_count(words, F.lower("para")))


def score_paragraphs(docs: DataFrame, key: str, text: str, queries: DataFrame, sep: str = "\n\n") -> DataFrame:
    """Every paragraph with every query of the table ``queries(query)`` that it has a word of, and its score. A
    paragraph is searched once for the words of all queries; null queries and texts give no rows."""
    p = docs.select(key, F.posexplode(F.split(text, re.escape(sep), -1)).alias("pos", "para"))
    words = queries.select("query", F.explode(query_words(F.col("query"))).alias("pattern"), F.lit(1).alias("weight"))
    return pattern_scores(p, F.lower("para"), words, "score")


def within_budget(paras: DataFrame, key: str, max_length: int) -> DataFrame:
    """W1 over a paragraph table: walk by score desc (ties by pos); stop at the first paragraph
    whose length would overflow; each kept one costs len + 2."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    used_before = F.coalesce(F.sum(F.length("para") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = paras.withColumn("_over", (used_before + F.length("para") > max_length).cast("int"))
    flagged = flagged.withColumn("_stopped", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.where(F.col("_stopped") == 0).drop("_over", "_stopped")


def chunk_text(df: DataFrame, text: str = "text", threshold: int = 4000, overlap: int = 200,
               keep: list[str] | None = None) -> DataFrame:
    """(keys, chunk_idx, start, chunk) with window 4*threshold and stride window - 4*overlap."""
    size = threshold * 4
    keep = keep or [c for c in df.columns if c != text]
    return (df.select(*keep, text, F.posexplode(chunk_starts(text, threshold, overlap)).alias("chunk_idx", "start"))
            .select(*keep, "chunk_idx", "start", F.substring(text, F.col("start") + 1, size).alias("chunk")))

