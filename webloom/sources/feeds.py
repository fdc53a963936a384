"""Search-engine result feeds read as data.

A feed table holds one raw answer document per row: ``(query, engine, doc_no, payload)`` where the
payload is the engine's JSON (or HTML for the lite HTML engine).  ``read_feed`` turns it into hit
rows ``(query, engine, engine_rank, doc_no, pos, title, url, snippet, score)``; ``doc_no, pos`` keep the
engine's own order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Engine order of the merged answer and each engine's base score.
ENGINE_RANK = {"whoogle": 0, "duckduckgo": 1, "bing": 2, "wikipedia": 3}
BASE_SCORE = {"whoogle": 0.9, "duckduckgo": 0.7, "bing": 0.8, "wikipedia": 0.75}
ENGINE_LABEL = {"whoogle": "Whoogle", "duckduckgo": "DuckDuckGo", "bing": "Bing", "wikipedia": "Wikipedia"}

_WHOOGLE = "struct<results: array<struct<title: string, url: string, href: string, snippet: string, body: string>>>"
_BING = "struct<webPages: struct<value: array<struct<name: string, url: string, snippet: string>>>>"
_WIKI = "struct<query: struct<search: array<struct<title: string, snippet: string>>>>"
HIT_COLS = ["query", "engine", "engine_rank", "doc_no", "pos", "title", "url", "snippet", "score"]


def _hits(df: DataFrame, engine: str, items, title, url, snippet) -> DataFrame:
    return (df.select("query", "doc_no", F.posexplode(items).alias("pos", "it"))
            .select("query", F.lit(engine).alias("engine"), F.lit(ENGINE_RANK[engine]).alias("engine_rank"),
                    "doc_no", "pos", title.alias("title"), url.alias("url"), snippet.alias("snippet"),
                    F.lit(BASE_SCORE[engine]).alias("score")))


def read_whoogle(raw: DataFrame) -> DataFrame:
    """results[]: title (default 'Untitled'), url else href else '#', snippet else body else ''."""
    it = F.col("it")
    doc = F.from_json("payload", _WHOOGLE)
    return _hits(raw.withColumn("_d", doc), "whoogle", F.col("_d.results"),
                 F.coalesce(it["title"], F.lit("Untitled")), F.coalesce(it["url"], it["href"], F.lit("#")),
                 F.coalesce(it["snippet"], it["body"], F.lit("")))


def read_bing(raw: DataFrame) -> DataFrame:
    """webPages.value[]: name, url, snippet."""
    it = F.col("it")
    return _hits(raw.withColumn("_d", F.from_json("payload", _BING)), "bing", F.col("_d.webPages.value"),
                 F.coalesce(it["name"], F.lit("Untitled")), F.coalesce(it["url"], F.lit("#")),
                 F.coalesce(it["snippet"], F.lit("")))


def read_wikipedia(raw: DataFrame, limits: dict | None = None) -> DataFrame:
    """Query.search[]: '<title> - Wikipedia', article URL, search-match spans removed; the snippet is cut at
    ``limits["wikipedia_snippet"]`` + '...' if that is given."""
    from webloom.functions.text import cut
    from webloom.functions.urls import wiki_url
    it = F.col("it")
    title = F.coalesce(it["title"], F.lit("Untitled"))
    snip = F.replace(F.replace(F.coalesce(it["snippet"], F.lit("")), F.lit('<span class="searchmatch">'), F.lit("")),
                     F.lit("</span>"), F.lit(""))
    return _hits(raw.withColumn("_d", F.from_json("payload", _WIKI)), "wikipedia", F.col("_d.query.search"),
                 F.concat(title, F.lit(" - Wikipedia")), wiki_url(title),
                 cut(snip, limits["wikipedia_snippet"]) if (limits or {}).get("wikipedia_snippet") else snip)


def read_duckduckgo(raw: DataFrame, limits: dict | None = None) -> DataFrame:
    """HTML answer: ``tr.result`` rows; ``a.result-link`` href/text and ``td.result-snippet``; rows without url or
    title are skipped. ``limits`` may hold ``rows`` (O6) and characters of ``title``, ``url`` and ``snippet``."""
    limits = limits or {}
    from webloom.operators.dom import parse_pages
    from webloom.operators.extract import extract_css
    parsed = parse_pages(raw.select("query", "doc_no", F.col("payload").alias("html")))
    rows = extract_css(parsed, "tr.result", {
        "url": {"selector": "a.result-link", "type": "attribute", "attribute": "href", "default": ""},
        "title": {"selector": "a.result-link", "default": None},
        "snippet": {"selector": "td.result-snippet", "default": ""},
    }, keep=["query", "doc_no"])
    rows = rows.where(F.col("title").isNotNull() & (F.col("url") != "") & (F.col("title") != ""))
    if "rows" in limits:
        rows = rows.where(F.col("pos") < limits["rows"])

    def text(name):
        return (F.substring(name, 1, limits[name]) if name in limits else F.col(name)).alias(name)
    return rows.select("query", F.lit("duckduckgo").alias("engine"), F.lit(ENGINE_RANK["duckduckgo"]).alias("engine_rank"),
                       "doc_no", "pos", text("title"), text("url"), text("snippet"),
                       F.lit(BASE_SCORE["duckduckgo"]).alias("score"))


#: The limits of the rule that the search queries reproduce.
USUAL_LIMITS = {"rows": 10, "title": 200, "url": 500, "snippet": 300, "wikipedia_snippet": 300}

READERS = {"whoogle": read_whoogle, "duckduckgo": read_duckduckgo, "bing": read_bing, "wikipedia": read_wikipedia}


def read_feed(raw: DataFrame, engine: str | None = None, limits: dict | None = None) -> DataFrame:
    """Dispatch on ``engine`` (or on the feed's ``engine`` column when None: one reader per engine, unioned). Without
    ``limits`` nothing is cut."""
    def read(e, rows):
        return READERS[e](rows, limits) if e in ("duckduckgo", "wikipedia") else READERS[e](rows)
    if engine is not None:
        return read(engine, raw)
    from functools import reduce
    parts = [read(e, raw.where(F.col("engine") == e)) for e in READERS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def feed_errors(raw: DataFrame) -> DataFrame:
    """Documents whose payload is not a readable answer -> ``(query, engine, error)``."""
    ok = (F.when(F.col("engine") == "duckduckgo", F.col("payload").isNotNull())
          .otherwise(F.try_parse_json("payload").isNotNull()))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ENGINE_LABEL.items() for x in kv]), F.col("engine"))
    return raw.where(~ok).select("query", "engine", F.concat(label, F.lit(": invalid payload")).alias("error"))
