"""Composite jobs, lookups, discovery, crawl and user functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans import jobs

PAGE = "url string, html string, status_code int, success boolean, error string, ts timestamp"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


@pytest.fixture
def archive(spark):
    return spark.createDataFrame([
        ("http://a.test/", "<title>New</title><p>x</p>", 200, True, None, T2), ("http://a.test/", "", 500, False, "HTTP 500", T1),
        ("http://b.test/", "", 404, False, "HTTP 404", T1), ("http://a.test/2", "<table><tr><th>k</th></tr><tr><td>1</td></tr></table>", 200, True, None, T1)], PAGE)


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_scan_marks_success(spark, tmp_path):
    from webloom.sources.pages import read_pages, successful
    spark.createDataFrame([("a", "x", 200), ("b", "y", 503), ("c", None, None)], "url string, html string, status_code int").write.parquet(str(tmp_path / "p"))
    pages = read_pages(spark, str(tmp_path / "p"))
    assert {(r.url, r.html, r.success, r.error) for r in pages.collect()} == {
        ("a", "x", True, None), ("b", "", False, "HTTP 503"), ("c", "", False, "HTTP ?")}
    assert [r.url for r in successful(pages).collect()] == ["a"]


def test_one_outcome_for_each_url(spark, archive):
    from webloom.sources.pages import fetch_batch
    rows = fetch_batch(urls(spark, "http://a.test/", "http://a.test/", "http://b.test/", "gone"), archive).collect()
    assert {(r.url, r.success, r.error) for r in rows} == {
        ("http://a.test/", True, None), ("http://b.test/", False, "HTTP 404"), ("gone", False, "not in page archive")} and len(rows) == 3


def test_outcomes_from_a_union_of_archives_without_broadcasts(spark, tmp_path):
    from webloom.sources.pages import fetch_batch
    spark.range(40).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("<p>x").alias("html")).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p")).withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    older = pages.withColumns({"html": F.lit(""), "success": F.lit(False), "error": F.lit("HTTP 500")})
    archive = pages.withColumn("ts", F.lit(2)).unionByName(older.withColumn("ts", F.lit(1)))
    wanted = pages.select("url").unionByName(pages.select("url")).unionByName(pages.select(F.concat("url", F.lit("#gone")).alias("url")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = fetch_batch(wanted, archive).select("url", "success", "error").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.url, r.success, r.error) for r in rows) == sorted(
        [(f"u{i}", True, None) for i in range(40)] + [(f"u{i}#gone", False, "not in page archive") for i in range(40)])


def test_scrape_parses_once(spark, archive):
    out = jobs.scrape(urls(spark, "http://a.test/", "gone"), archive)
    rows = {r.url: r for r in out.collect()}
    assert len(rows) == out.count() == 2
    assert (rows["http://a.test/"].title, rows["http://a.test/"].markdown, rows["http://a.test/"].error) == ("New", "New\nx", None)
    assert (rows["gone"].markdown, rows["gone"].metadata, rows["gone"].error) == ("", None, "not in page archive")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_extract_records_or_tables(spark, archive):
    recs = jobs.extract(urls(spark, "http://a.test/"), archive, "p", {"t": "@"}).collect()
    assert [(r.url, r.t) for r in recs] == [("http://a.test/", "x")]
    tables = jobs.extract(urls(spark, "http://a.test/2"), archive).collect()
    assert [(r.url, r.headers, r.rows) for r in tables] == [("http://a.test/2", ["k"], [["k"], ["1"]])]


def test_crawl_converts_a_page_once_and_stops_at_its_cap(spark):
    link = lambda *to: "".join(f'<a href="{t}">l</a>' for t in to)
    arch = spark.createDataFrame([
        ("http://s.test/0", link("/1", "/2", "/gone", "http://o.test/"), True), ("http://s.test/1", link("/3"), True),
        ("http://s.test/2", link("/0"), True), ("http://s.test/3", link("/4"), True), ("http://s.test/4", "", False), ("http://o.test/", "", True)],
        "url string, html string, success boolean")
    seeds = spark.createDataFrame([("x", "http://s.test/0"), ("y", "http://s.test/2"), ("z", "http://s.test/4")], "seed string, url string")
    md, summary = jobs.crawl_to_markdown(seeds, arch, max_depth=5)
    assert {(r.seed, r.url[-1], r.depth) for r in md.collect()} == {
        ("x", "0", 0), ("x", "1", 1), ("x", "2", 1), ("x", "3", 2), ("y", "2", 0), ("y", "0", 1), ("y", "1", 2), ("y", "3", 3)}
    assert {tuple(r) for r in summary.collect()} == {("x", 4, 2), ("y", 4, 3)}
    from webloom.operators.crawl import crawl
    capped = crawl(seeds, arch, max_depth=5, max_pages=2).collect()
    assert {(r.seed, r.url[-1]) for r in capped} == {("x", "0"), ("x", "1"), ("y", "2"), ("y", "0")}
    other = crawl(seeds.where("seed = 'x'"), arch, max_depth=1, same_domain_only=False).collect()
    assert "http://o.test/" in {r.url for r in other}


def test_shared_sitemaps_are_not_multiplied(spark):
    from webloom.sources.sitemaps import read_sitemap, robots_to_sitemaps
    sm = "<urlset><url><loc>http://u/1</loc></url><url><loc>http://u/2</loc></url></urlset>"
    docs = spark.createDataFrame([(f"http://h{i}/robots.txt", "Sitemap: http://cdn/s.xml") for i in range(3)] + [
        ("http://cdn/s.xml", sm), ("http://bad/s.xml", "<urlset><url><loc>http://u/3</loc>")], "url string, content string")
    out = robots_to_sitemaps(docs.where(F.col("url").endswith("robots.txt")), docs)
    assert out.count() == 6 and out.select("key", "loc").distinct().count() == 6
    assert [r["loc"] for r in read_sitemap(docs.where("url = 'http://bad/s.xml'")).collect()] == ["http://u/3"]


def test_discovery_limit_and_methods(spark):
    from webloom.operators.discovery import discover
    docs = spark.createDataFrame([
        ("http://h/robots.txt", "Sitemap: http://h/r.xml"), ("http://h/r.xml", "<urlset><url><loc>http://h/r1</loc></url><url><loc>http://h/m</loc></url></urlset>"),
        ("http://h/sitemap.xml", "<urlset><url><loc>http://h/m</loc></url></urlset>"), ("http://h/", '<a href="/l1">x</a><a href="/r1">y</a>')],
        "url string, content string")
    sites = spark.createDataFrame([("http://h/",)], "site string")
    found = discover(sites, docs).orderBy("rank").collect()
    assert [(r.method, r.url) for r in found] == [("sitemap", "http://h/m"), ("robots", "http://h/r1"), ("links", "http://h/l1")]
    assert [r.url for r in discover(sites, docs, max_urls=1).collect()] == ["http://h/m"]
    assert [(r.total_urls, r.methods_used) for r in jobs.discovery_summary(discover(sites, docs)).collect()] == [(3, ["links", "robots", "sitemap"])]


def test_query_tables(spark):
    from webloom.operators import fit
    from webloom.operators.discovery import score_urls
    queries = spark.createDataFrame([(f"w{i}",) for i in range(600)] + [("red boat",), ("red boat",), (None,)], "query string")
    docs = spark.createDataFrame([(1, "a Red boat\n\nnothing\n\nboats w7")], "k long, t string")
    got = {(r.pos, r["query"], r.score) for r in fit.score_paragraphs(docs, "k", "t", queries).collect()}
    assert got == {(0, "red boat", 2), (2, "red boat", 1), (2, "w7", 1)}
    rows = score_urls(spark.createDataFrame([("http://x/Red%20boat-w12",)], "url string"), queries).collect()
    assert {(r["query"], r.relevance_score) for r in rows} == {("red boat", 2), ("w12", 11), ("w1", 11)}


def test_crawl_of_many_seeds_against_a_loop(spark):
    """200 seeds on two hosts: bitmaps of several blocks, with and without a cap."""
    import random
    from webloom.operators.crawl import crawl
    rng = random.Random(4)
    urls = [f"http://h{i % 2}/p{i}" for i in range(120)]
    out = {u: sorted({rng.choice(urls) for _ in range(2)}) for u in urls}
    arch = spark.createDataFrame([(u, "".join(f'<a href="{v}">x</a>' for v in out[u]), u != urls[7]) for u in urls], "url string, html string, success boolean")
    seeds = [(u, u) for u in urls] + [(f"http://h0/s{i}", rng.choice(urls)) for i in range(80)] + [("http://none/", "http://none/")]
    table = spark.createDataFrame(seeds + seeds[:5], "seed string, url string")

    def loop(start, cap):
        depth, level = ({start: 0} if start in out and start != urls[7] else {}), [start]
        for d in range(1, 4):
            if cap and len(depth) >= cap:
                break
            level = [v for u in level if u in depth for v in out[u] if v.split("/")[2] == u.split("/")[2] and v != urls[7] and v not in depth]
            depth |= dict.fromkeys(level, d)
        return sorted((d, u) for u, d in depth.items())[:cap]
    for cap in (None, 5):
        got = {(r.seed, r.url, r.depth) for r in crawl(table, arch, max_depth=3, max_pages=cap).collect()}
        assert got == {(s, u, d) for s, start in seeds for d, u in loop(start, cap)}


def test_page_callbacks_and_replay(spark, tmp_path):
    """A callback that fails gets its batch again, with the same id and rows."""
    import pytest
    pages = spark.createDataFrame([(f"u{i}", "x" * i) for i in range(20)], "url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    calls, kept = [], {}

    def fn(batch, batch_id):
        calls.append(batch_id)
        kept[batch_id] = sorted(r.url for r in batch.collect())
        if len(calls) == 1:
            raise RuntimeError("lost")
    with pytest.raises(Exception):
        jobs.for_each_batch(src, fn, str(tmp_path / "ck")).awaitTermination()
    jobs.for_each_batch(src, fn, str(tmp_path / "ck")).awaitTermination()
    assert calls == [0, 0] and sorted(sum(kept.values(), [])) == sorted(f"u{i}" for i in range(20))

    def count(rows):
        n = sum(len(r["html"]) for r in rows)
        if n > 100:
            raise ValueError("large")
        return n
    got = jobs.for_each_partition(pages.repartitionByRange(2, F.length("html")), count).orderBy("partition").collect()
    assert [(r.rows, r.result, r.error) for r in got] == [(10, 45.0, None), (10, None, "ValueError: large")]


def test_a_hot_site_is_ranked_in_ranges(spark):
    from webloom.operators.discovery import limit_urls
    rows = [("hot" if i % 3 else f"s{i % 5}", f"u{i:04d}", i % 2, i // 50, None, i % 7) for i in range(3000)] + [(None, "x", 0, 0, 0, 0)]
    urls = spark.createDataFrame(rows, "site string, url string, method_rank int, o0 int, o1 int, o2 int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked, first = limit_urls(urls), limit_urls(urls, 7)
        got = {(r.site, r.url): r["rank"] for r in ranked.collect()}
        few = {(r.site, r.url): r["rank"] for r in first.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, seen = {}, {}
    for site, url, *_ in sorted(rows, key=lambda r: (str(r[0]), r[2], r[3], r[5], r[1])):
        seen[site] = seen.get(site, 0) + 1
        want[site, url] = seen[site]
    assert got == want and few == {k: v for k, v in want.items() if v <= 7}


def test_many_queries_in_blocks(spark, monkeypatch):
    """10,000 queries against a plain loop, in several blocks; no nested loop or cartesian product in the plan."""
    from webloom.operators import fit, matching
    from webloom.operators.discovery import score_urls
    monkeypatch.setattr(matching, "BLOCK_PATTERNS", 6000)
    asked = [f"W{i % 700} b{i}" for i in range(10_000)] + ["", "  ", None, "É a", "http"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    texts = ["w1 b1 w12", "", None, "B9999 w69", "é", "nothing of it", "http://w5b5"]
    urls = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "k long, url string, query string")
    scored = score_urls(urls, queries)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and scored.columns == ["k", "url", "query", "relevance_score"]
    want = set()
    for k, t in enumerate(texts):
        for q in set(asked) - {None} if t is not None else ():
            score = 10 * (q.lower() in t.lower()) + sum(w in t.lower() for w in set(q.lower().split()))
            if score:
                want.add((k, q, score))
    assert {(r.k, r["query"], r.relevance_score) for r in scored.collect()} == want
    docs = urls.select("k", F.col("url").alias("t"))
    got = {(r.k, r["query"], r.score) for r in fit.score_paragraphs(docs, "k", "t", queries).collect()}
    assert got == {(k, q, n) for k, t in enumerate(texts) if t is not None for q in set(asked) - {None}
                   if (n := sum(w in t.lower() for w in set(q.lower().split())))}


def test_table_extraction_both_halves(spark):
    schema = T.StructType([T.StructField("headers", T.ArrayType(T.StringType()), False)])
    docs = spark.createDataFrame([(1, "  <p>page</p>"), (2, "plain " * 2000), (3, None)], "doc_id long, text string")
    req = jobs.table_requests(docs, "doc_id", "text", schema, chunk_threshold=1000, overlap=100)
    texts = {(r.doc_id, r.chunk_idx): r.user_prompt for r in req.collect()}
    assert "page" in texts[1, 0] and "<p>" not in texts[1, 0] and sum(k[0] == 2 for k in texts) == 4 and (3, 0) in texts
    with pytest.raises(ValueError):
        jobs.table_requests(docs, "doc_id", "text", schema, chunk_threshold=1000, max_tokens=999)
    resp = spark.createDataFrame([(1, 0, '[{"headers": ["a"], "rows": [["1"]], "caption": "c"}]'), (1, 1, '{"items": [{"headers": ["a"], "rows": [["2"]]}]}'),
                                  (1, 2, '[{"headers": ["b"], "rows": [["3"]]}]')], "doc_id long, chunk_idx int, response string")
    out = [(r.headers, r.caption, r.row) for r in jobs.table_extraction(resp).orderBy("headers", "chunk_idx").collect()]
    assert out == [(["a"], "c", ["1"]), (["a"], "c", ["2"]), (["b"], None, ["3"])]


def test_user_functions_strategies_and_metrics(spark, archive, parse):
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.LongType())])

    def count(rec):
        if rec["status_code"] == 404:
            raise KeyError("missing")
        return {"url": rec["url"], "n": len(rec["html"])}
    rows = jobs.process_pages(archive, count, schema).collect()
    assert sorted((r.n is None, r.error is None) for r in rows) == [(False, True)] * 3 + [(True, False)]

    class Tags:
        def apply(self, parsed):
            return parsed.select(F.size("nodes").alias("n"))
    page = parse("<p>a<b>c</b></p>")
    assert jobs.apply_strategy(page, Tags()).first().n == jobs.apply_strategy(page, Tags().apply).first().n == 2
    df, obs = jobs.observed(archive)
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"total": 4, "succeeded": 2}


def test_field_transform(parse):
    from webloom.operators.extract import Field, extract_css
    out = extract_css(parse("<b> 4 km</b>"), "b", {"t": Field(selector="@", transform=F.upper)}).collect()
    assert out[0].t == "4 KM"


def test_latest_page_is_found_without_a_second_shuffle_of_markup(spark):
    from webloom.sources.pages import fetch_batch, latest_pages
    rows = [("a", 1, True, "x"), ("a", 2, False, "y"), ("a", 2, True, "z"), ("a", 2, True, "zz"), ("a", 2, True, "zz"), ("b", None, True, "n"),
            ("b", None, False, "m"), ("c", None, None, None), (None, 3, True, "q"), (None, 4, True, "r"), ("", 9, True, "s"), ("d", 5, None, "k"), ("d", 5, False, "l")]
    pages = spark.createDataFrame(rows, "url string, ts int, success boolean, html string")
    got = {(r.url, r.ts, r.success, r.html) for r in latest_pages(pages).collect()}
    assert got == {("a", 2, True, "zz"), ("b", None, True, "n"), ("c", None, None, None), (None, 4, True, "r"), ("", 9, True, "s"), ("d", 5, False, "l")}
    assert latest_pages(pages.drop("ts", "success")).count() == 6 and latest_pages(pages.limit(0)).count() == 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = latest_pages(pages.where("url is not null"))._jdf.queryExecution().executedPlan().toString()
        fetched = fetch_batch(pages.select("url"), pages.withColumn("error", F.lit(None).cast("string")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") <= 3, plan  # the columns of the pick, the markup, rows without a URL
    # the wanted URLs for each of three joins, the columns of the pick, the markup: nothing is dealt out again
    assert fetched.count("Exchange hashpartitioning") == 5, fetched
