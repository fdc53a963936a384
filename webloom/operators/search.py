"""Merging and ranking of search hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import match_count, query_words
from webloom.functions.urls import normalize_url
from webloom.sources.feeds import ENGINE_RANK, HIT_COLS

# Authoritative-domain markers and score increments.
AUTHORITY_MARKERS = [".edu", ".gov", "wikipedia.org"]
TITLE_BOOST, SNIPPET_BOOST, AUTHORITY_BOOST, HTTPS_BOOST, DEFAULT_SCORE = 0.15, 0.05, 0.1, 0.02, 0.5


def union_feeds(*hits: DataFrame) -> DataFrame:
    """All engines' hits in one table (``engine_rank`` carries the engine order)."""
    return reduce(lambda a, b: a.unionByName(b), [h.select(*HIT_COLS) for h in hits])


def with_fallback(hits: DataFrame, fallback_engine: str = "wikipedia") -> DataFrame:
    """Use the fallback engine's hits only for queries without any hit from the others. ``hits`` is read twice:
    give a table, not a parse. The queries that others answer come from a partial aggregate, one row a query and task."""
    fb = F.col("engine") == fallback_engine
    answered = hits.where(~fb).select("query").distinct()
    return hits.where(~fb).unionByName(hits.where(fb).join(answered, "query", "left_anti"))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """A1: key = lower(trim(url)) minus trailing '/'; blank keys dropped; first hit in
    (engine_rank, doc_no, pos) order wins.  An aggregate (partial before the shuffle), not a window."""
    keyed = hits.withColumn("key", normalize_url("url")).where(F.col("key") != "")
    first = F.min(F.struct("engine_rank", "doc_no", "pos", *[c for c in HIT_COLS if c not in ("engine_rank", "doc_no", "pos")]))
    return keyed.groupBy("query", "key").agg(first.alias("h")).select("query", "key", *[F.col("h")[c].alias(c) for c in HIT_COLS if c != "query"])


def hit_score(base: Column, title: Column, snippet: Column, url: Column, words: Column) -> Column:
    """F8: base (0.5 when missing) + 0.15 per query word in the title + 0.05 per word in the snippet
    + 0.1 for an authoritative domain + 0.02 for https; capped at 1.0.  Same addition order as the rule."""
    s = F.coalesce(base, F.lit(DEFAULT_SCORE))
    s = s + match_count(words, F.lower(F.coalesce(title, F.lit("")))) * TITLE_BOOST
    s = s + match_count(words, F.lower(F.coalesce(snippet, F.lit("")))) * SNIPPET_BOOST
    u = F.coalesce(url, F.lit(""))
    auth = reduce(lambda a, b: a | b, [F.instr(u, m) > 0 for m in AUTHORITY_MARKERS])
    s = F.when(auth, s + AUTHORITY_BOOST).otherwise(s)
    s = F.when(u.startswith("https://"), s + HTTPS_BOOST).otherwise(s)
    return F.least(s, F.lit(1.0))


def score_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", hit_score(F.col("score"), F.col("title"), F.col("snippet"), F.col("url"),
                                              query_words(F.col("query"))))


def stable_rank(df: DataFrame, by: str = "query", score: str = "score", order=("engine_rank", "doc_no", "pos")) -> Column:
    """1-based rank by score desc, ties in input order."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *order))


def top_hits(ranked: DataFrame, n: int = 10, by: str = "query") -> DataFrame:
    """O1: top n per query.  ``row_number() <= n`` lets Spark insert a partial group limit before the
    shuffle, so a query with millions of hits ships n rows per map task."""
    return ranked.withColumn("rank", stable_rank(ranked, by)).where(F.col("rank") <= n)


def assemble_answers(top: DataFrame, hits: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A3: per query: results (ordered array), total_results, engines_used (engines with >= 1 hit,
    in engine order), errors or NULL (each different message of an engine once, so their number is bounded by the
    engines and messages, not by the documents that failed)."""
    engines = (hits.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("engine_rank", "engine"))).alias("e"))
               .select("query", F.transform("e", lambda x: x["engine"]).alias("engines_used")))
    res = (top.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "url", "snippet", "engine", "score"))).alias("results"))
        .withColumn("total_results", F.size("results")))
    out = engines.join(res, "query", "left").select(
        "query", F.coalesce("results", F.array().cast(res.schema["results"].dataType)).alias("results"),
        F.coalesce("total_results", F.lit(0)).alias("total_results"), "engines_used")
    if errors is not None:
        errs = errors.select("query", "engine", "error").distinct().groupBy("query").agg(F.array_sort(F.collect_list(F.struct(
            F.element_at(F.create_map(*[F.lit(x) for kv in ENGINE_RANK.items() for x in kv]), F.col("engine")).alias("r"),
            "error"))).alias("errs"))
        out = out.join(errs, "query", "full").select(
            "query", F.coalesce("results", F.array().cast(res.schema["results"].dataType)).alias("results"),
            F.coalesce("total_results", F.lit(0)).alias("total_results"),
            F.coalesce("engines_used", F.array().cast("array<string>")).alias("engines_used"),
            F.transform("errs", lambda x: x["error"]).alias("errors"))
    else:
        out = out.withColumn("errors", F.lit(None).cast("array<string>"))
    return out
