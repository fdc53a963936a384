"""Sitemaps and robots files read from a fetched-document table ``docs(url, content)``.

Parsing is native ``from_xml`` (namespace-agnostic, typed ``lastmod DATE``/``priority DOUBLE``);
a document that is not well-formed falls back to the ``<loc>`` regex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITEMAP_SCHEMA = ("url ARRAY<STRUCT<loc: STRING, lastmod: DATE, changefreq: STRING, priority: DOUBLE>>, "
                  "sitemap ARRAY<STRUCT<loc: STRING>>")
ENTRY = "struct<loc: string, lastmod: date, changefreq: string, priority: double>"


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("url", "content", F.from_xml("content", SITEMAP_SCHEMA).alias("x"))


def read_sitemap(docs: DataFrame) -> DataFrame:
    """S3: ``<url>`` entries of urlset documents -> (sitemap_url, pos, loc, lastmod, changefreq, priority).
    Malformed XML: every ``<loc>`` text (untrimmed, untyped)."""
    p = _parsed(docs.where(~F.col("content").contains("<sitemapindex")))
    fallback = F.transform(F.regexp_extract_all("content", F.lit("<loc>([^<]+)</loc>"), 1),
                           lambda l: F.struct(l.alias("loc"), F.lit(None).cast("date").alias("lastmod"),
                                              F.lit(None).cast("string").alias("changefreq"),
                                              F.lit(None).cast("double").alias("priority")))
    broken = F.col("x.url").isNull() & F.col("x.sitemap").isNull()
    entries = F.when(broken, fallback).otherwise(F.col("x.url"))
    e = p.select(F.col("url").alias("sitemap_url"), F.posexplode(entries).alias("pos", "e"))
    return e.where(F.col("e.loc").isNotNull() & (F.col("e.loc") != "")).select(
        "sitemap_url", "pos", "e.loc", "e.lastmod", "e.changefreq", "e.priority")


def index_children(docs: DataFrame) -> DataFrame:
    """Child sitemap locations of sitemap-index documents -> (index_url, pos, child);
    malformed index: ``<loc>`` texts ending in .xml."""
    p = _parsed(docs.where(F.col("content").contains("<sitemapindex")))
    fallback = F.filter(F.regexp_extract_all("content", F.lit("<loc>([^<]+)</loc>"), 1), lambda l: l.endswith(".xml"))
    broken = F.col("x.url").isNull() & F.col("x.sitemap").isNull()
    locs = F.when(broken, fallback).otherwise(F.transform(F.col("x.sitemap"), lambda s: s["loc"]))
    return (p.select(F.col("url").alias("index_url"), F.posexplode(locs).alias("pos", "child"))
            .where(F.col("child").isNotNull() & (F.col("child") != "")))


def expand_sitemap_index(docs: DataFrame, recursive: bool = True, indexes: DataFrame | None = None) -> DataFrame:
    """Index -> child sitemaps (equi-join on the child URL) -> their entries, one level.
    A nested index found there yields its child sitemap URLs as they are.  ``recursive=False``
    yields the child URLs only.  ``indexes``: the index documents to expand (default: all of ``docs``).
    -> (index_url, o1, o2, loc)."""
    kids = index_children(docs if indexes is None else indexes)
    if not recursive:
        return kids.select("index_url", F.col("pos").alias("o1"), F.lit(0).alias("o2"), F.col("child").alias("loc"))
    child_docs = docs.join(kids.select(F.col("child").alias("url")).distinct(), "url", "left_semi")
    entries = read_sitemap(child_docs).select(F.col("sitemap_url").alias("child"), F.col("pos").alias("o2"), "loc")
    nested = index_children(child_docs).select(F.col("index_url").alias("child"), F.col("pos").alias("o2"),
                                               F.col("child").alias("loc"))
    below = entries.unionByName(nested)
    return kids.join(below, "child").select("index_url", F.col("pos").alias("o1"), "o2", "loc")


def read_robots(docs: DataFrame) -> DataFrame:
    """``Sitemap:`` directives (leading blanks allowed), trimmed, blanks dropped -> (robots_url, pos, sitemap)."""
    d = F.regexp_extract_all("content", F.lit(r"(?m)^\s*[Ss]itemap:\s*(.+)$"), 1)
    return (docs.select(F.col("url").alias("robots_url"), F.posexplode(F.transform(d, F.trim)).alias("pos", "sitemap"))
            .where(F.col("sitemap") != ""))


def sitemap_urls(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """URLs behind sitemap documents named in ``roots(key, o0, url)``: a urlset gives its entries, an index gives its
    children's entries (J5). However many roots name a document, it is read once: only documents that are wanted, or
    are children of a wanted index, are parsed. -> (key, o0, o1, o2, loc)."""
    wanted = roots.select("url").distinct()
    named = docs.join(wanted, "url", "left_semi")
    plain = read_sitemap(named).select(F.col("sitemap_url").alias("url"), F.lit(0).alias("o1"), F.col("pos").alias("o2"), "loc")
    idx = expand_sitemap_index(docs, indexes=named).select(F.col("index_url").alias("url"), "o1", "o2", "loc")
    return roots.join(plain.unionByName(idx), "url").select("key", "o0", "o1", "o2", "loc")


def robots_to_sitemaps(robots: DataFrame, docs: DataFrame) -> DataFrame:
    """Robots directive -> the sitemap document it names (equi-join) -> its URLs."""
    d = read_robots(robots).select(F.col("robots_url").alias("key"), F.col("pos").alias("o0"),
                                   F.col("sitemap").alias("url"))
    return sitemap_urls(docs, d)
