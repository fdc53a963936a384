"""Crawl (C2): level-synchronous BFS over a page archive, many seeds at once.

The archive is ``(url, html, success)``; links are extracted once from successful pages into an
edge table ``(src, dst)`` that every level reads. Frontier and visited set have one row a URL and block of 64 seeds, with a
bitmap of the seeds that have reached it, so seeds on one site share its edges. A level is one join of the frontier
with the edges, a bit-or by target, and an and-not against the levels before; the driver only runs one emptiness
check per level (at most ``max_depth``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.urls import link_ok, netloc, resolve_url, same_netloc
from webloom.session import materialize
from webloom.sources.pages import successful


def link_edges(archive: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Crawl-variant X8: every usable ``a[href]`` of a successful page, always resolved -> (src, dst)."""
    from webloom.operators.dom import parse_pages
    from webloom.operators.extract import find_all
    parsed = parse_pages(archive.select(F.col(url).alias("src"), F.col(html).alias("html")))
    hrefs = F.transform(find_all(lambda n: (n["tag"] == "a") & n["attrs"].getItem("href").isNotNull()),
                        lambda a: a["attrs"].getItem("href"))
    e = parsed.select("src", F.explode(hrefs).alias("href")).where(link_ok(F.col("href")))
    return e.select("src", resolve_url(F.col("src"), F.col("href")).alias("dst")).distinct()


def crawl(seeds: DataFrame, archive: DataFrame, max_depth: int = 3, same_domain_only: bool = True,
          max_pages: int | None = None) -> DataFrame:
    """-> (seed, url, depth): successful pages reachable from each seed within ``max_depth`` levels,
    each at its first depth; links are followed only out of successful pages; with
    ``same_domain_only`` the domain is fixed by the seed URL.  ``max_pages`` keeps the first pages by
    (depth, url) per seed, as the crawl's page cap (default: all).

    Edges that no crawl can use go before the loop: links to pages that the archive lacks and, with
    ``same_domain_only``, links to another host (a crawl never leaves its seed's). Each level writes its own new pages
    only; what was visited is the union of the levels. A seed whose cap is reached goes no deeper: pages of deeper
    levels come after it."""
    ok = successful(archive).select("url", "html")
    ok_urls = ok.select("url").distinct()
    edges = link_edges(ok)
    if same_domain_only:
        edges = edges.where(same_netloc(F.col("src"), F.col("dst")))
    edges = materialize(edges.join(ok_urls.withColumnRenamed("url", "dst"), "dst", "left_semi"), "edges")
    numbered = materialize(_numbered(seeds), "seeds")
    start = seeds.select("seed", "url").distinct().join(ok_urls, "url", "left_semi").join(numbered, "seed")
    bit = F.expr("shiftleft(1L, bit)")
    frontier = materialize(start.groupBy("url", "block").agg(F.bit_or(bit).alias("bits")).withColumn("depth", F.lit(0)), "level")
    levels = [frontier]
    for d in range(1, max_depth + 1):
        visited = reduce(lambda a, b: a.unionByName(b), levels)
        if max_pages:
            frontier = (frontier.join(_capped(visited, max_pages), "block", "left")
                        .withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("full", F.lit(0).cast("long")))))
                        .where("bits <> 0").drop("full"))
        reached = frontier.join(edges, frontier.url == edges.src).groupBy(F.col("dst").alias("url"), "block").agg(F.bit_or("bits").alias("bits"))
        seen = visited.groupBy("url", "block").agg(F.bit_or("bits").alias("seen"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        frontier = materialize(reached.join(seen, ["url", "block"], "left").select("url", "block", new.alias("bits"), F.lit(d).alias("depth"))
                               .where("bits <> 0"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    found = reduce(lambda a, b: a.unionByName(b), levels)
    out = _seeds_of(found, "url", "depth").join(numbered, ["block", "bit"]).select("seed", "url", "depth")
    if max_pages:
        rk = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))
        out = out.withColumn("_rk", rk).where(F.col("_rk") <= max_pages).drop("_rk")
    return out


def _numbered(seeds: DataFrame) -> DataFrame:
    """``seed, block, bit``: seeds of one host follow each other, so that a block's 64 seeds mostly meet the same pages."""
    order = seeds.select("seed").distinct().withColumn("host", netloc(F.col("seed")))
    ranged = order.repartitionByRange("host", "seed").sortWithinPartitions("host", "seed").withColumn("id", F.monotonically_increasing_id())
    return ranged.select("seed", F.shiftright("id", 6).alias("block"), F.col("id").bitwiseAND(F.lit(63)).cast("int").alias("bit"))


def _seeds_of(found: DataFrame, *columns: str) -> DataFrame:
    """``columns, block, bit``: one row for every seed in a bitmap."""
    return found.select(*columns, "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)).alias("bit"))


def _capped(visited: DataFrame, max_pages: int) -> DataFrame:
    """``block, full``: the seeds that have ``max_pages`` pages."""
    counts = _seeds_of(visited).groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_pages)
    return counts.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("full"))
