"""URL discovery (A2, O3, O4, F9, U2, C3, C4): sitemap -> robots -> homepage links, first occurrence wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import match_count, query_words
from webloom.functions.urls import link_ok, resolve_url, same_netloc, site_root
from webloom.operators.matching import pattern_scores
from webloom.session import materialize
from webloom.sources.sitemaps import read_robots, sitemap_urls

METHODS = ["sitemap", "robots", "links"]


def homepage_links(sites: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of each site's start page (same netloc only), in document order -> (site, o0, o1, o2, url)."""
    from webloom.operators.dom import parse_pages
    from webloom.operators.extract import find_all
    pages = sites.join(docs.select(F.col("url").alias("site"), F.col("content").alias("html")), "site")
    parsed = parse_pages(pages.select("site", "html"))
    hrefs = F.transform(find_all(lambda n: (n["tag"] == "a") & n["attrs"].getItem("href").isNotNull()),
                        lambda a: a["attrs"].getItem("href"))
    e = parsed.select("site", F.posexplode(hrefs).alias("o1", "href")).where(link_ok(F.col("href")))
    e = e.withColumn("url", resolve_url(F.col("site"), F.col("href")))
    return e.where(same_netloc(F.col("url"), F.col("site"))).select(
        "site", F.lit(0).alias("o0"), "o1", F.lit(0).alias("o2"), "url")


def union_methods(sites: DataFrame, docs: DataFrame, methods=None) -> DataFrame:
    """Discovered URLs of the selected methods -> (site, method_rank, o0, o1, o2, url).

    The sitemap and robots methods name their documents together: all named documents are read in one pass, each once
    however many sites and methods name it."""
    methods = methods or METHODS
    root = site_root(F.col("site"))
    names, parts = [], []
    if "sitemap" in methods:
        names.append(sites.select(F.struct("site", F.lit(0).alias("method_rank")).alias("key"), F.lit(0).alias("o0"),
                                  F.concat(root, F.lit("/sitemap.xml")).alias("url")))
    if "robots" in methods:
        robots = sites.select(F.concat(root, F.lit("/robots.txt")).alias("url"), "site")
        lines = read_robots(docs.join(robots.select("url").distinct(), "url", "left_semi"))
        names.append(lines.join(robots, lines.robots_url == robots.url).select(
            F.struct("site", F.lit(1).alias("method_rank")).alias("key"), F.col("pos").alias("o0"), F.col("sitemap").alias("url")))
    if names:
        named = materialize(reduce(lambda a, b: a.unionByName(b), names), "sitemaps")
        parts.append(sitemap_urls(docs, named).select("key.site", "key.method_rank", "o0", "o1", "o2", F.col("loc").alias("url")))
    if "links" in methods:
        parts.append(homepage_links(sites, docs).select("site", F.lit(2).alias("method_rank"), "o0", "o1", "o2", "url"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_first(urls: DataFrame) -> DataFrame:
    """A2: exact-string distinct per site keeping the first occurrence's order (a partial aggregate)."""
    first = F.min(F.struct("method_rank", "o0", "o1", "o2"))
    return urls.groupBy("site", "url").agg(first.alias("o")).select("site", "url", "o.*")


def limit_urls(urls: DataFrame, n: int | None = None) -> DataFrame:
    """First n per site in discovery order (None: all), with 1-based ``rank``.

    Rows are dealt by ranges of (site, order), so that a site with a third of all URLs lies in many tasks, and are
    ranked inside their range; the counts of a site's earlier ranges, one row each, are added."""
    order = ["method_rank", "o0", "o1", "o2", "url"]
    ranged = materialize(materialize(urls, "urls").repartitionByRange("site", *order).withColumn("_part", F.spark_partition_id()), "ranged-urls")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("site", "_part").orderBy(*order)))
    before = Window.partitionBy("site").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("site", "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("site").alias("_site"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if n is not None:
        local = local.where(F.col("_local") <= n)
    ranked = (local.join(base, F.col("site").eqNullSafe(F.col("_site")) & (F.col("_part") == F.col("_p")))
              .withColumn("rank", (F.col("_local") + F.col("_before")).cast("int")).drop("_site", "_p", "_part", "_local", "_before"))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def discover(sites: DataFrame, docs: DataFrame, methods=None, max_urls: int | None = None) -> DataFrame:
    """-> (site, rank, method, url); ``max_urls`` keeps the first URLs of each site (O4), default all."""
    names = F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("method_rank") + 1)
    out = limit_urls(distinct_first(union_methods(sites, docs, methods)), max_urls)
    return out.select("site", "rank", names.alias("method"), "url")


def relevance(url: Column, query: Column) -> Column:
    """+10 when the whole lower-cased query is in the lower-cased URL, +1 per query word in it."""
    u, q = F.lower(url), F.lower(query)
    return F.when(F.instr(u, q) > 0, 10).otherwise(0) + match_count(query_words(query), u)


def url_relevance(url, query: str) -> Column:
    """F9 for one literal query."""
    return relevance(F.col(url) if isinstance(url, str) else url, F.lit(query))


def score_urls(urls: DataFrame, queries: DataFrame, url: str = "url") -> DataFrame:
    """Every URL with every query of the table ``queries(query)`` that it is relevant to, and its score (F9). A URL
    is searched once for all queries and their words; null queries and URLs give no rows."""
    word = queries.select("query", F.explode(query_words(F.col("query"))).alias("pattern"), F.lit(1).alias("weight"))
    whole = queries.select("query", F.lower("query").alias("pattern"), F.lit(10).alias("weight"))
    both = whole.unionByName(word).groupBy("query", "pattern").agg(F.sum_distinct("weight").alias("weight"))
    return pattern_scores(urls, F.lower(F.col(url)), both.withColumn("weight", F.col("weight").cast("int")), "relevance_score")


def search_within_site(sites: DataFrame, docs: DataFrame, query: str, n: int = 20, max_urls: int | None = None) -> DataFrame:
    """C4: discover, score, keep score > 0, stable sort by score desc, top n (O3)."""
    found = discover(sites, docs, max_urls=max_urls).withColumn("relevance_score", url_relevance("url", query))
    w = Window.partitionBy("site").orderBy(F.desc("relevance_score"), "rank")
    return (found.where(F.col("relevance_score") > 0).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= n).select("site", "pos", "url", "relevance_score"))
