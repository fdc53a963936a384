"""Composite jobs (C1-C9 and small summaries) built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import netloc
from webloom.session import materialize


def host_link_counts(parsed: DataFrame) -> DataFrame:
    """Flagship: links per target host. Spark expands the two distinct counts and deals the rows by (host, page) and
    (host, url), so a host that holds a third of all links is spread over the shuffle; by host only sums meet."""
    from webloom.operators.extract import extract_links
    links = extract_links(parsed)
    return (links.groupBy(netloc("url").alias("host"))
            .agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"),
                 F.countDistinct("url").alias("distinct_targets")))


def search(feeds: DataFrame, n: int = 10, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Feeds -> (top-n ranked hits, one answer row per query). Every feed document is parsed once: the hits are
    written to the shared checkpoint folder and read by ranking, fallback and answers. ``limits``: see ``read_feed``."""
    from webloom.operators.search import assemble_answers, dedupe_hits, score_hits, top_hits, with_fallback
    from webloom.sources.feeds import feed_errors, read_feed
    hits = with_fallback(materialize(read_feed(feeds, limits=limits), "hits"))
    top = top_hits(score_hits(dedupe_hits(hits)), n)
    return top, assemble_answers(top, hits, feed_errors(feeds))


def check_for_changes(current: DataFrame, snapshots: DataFrame):
    """(change events, next snapshot table)."""
    from webloom.operators.changes import detect_changes, next_snapshots
    changes = detect_changes(current, snapshots)
    return changes, next_snapshots(changes, snapshots)


def scrape(urls: DataFrame, pages: DataFrame, options=None, partitions: int | None = None) -> DataFrame:
    """URL list -> archive lookup -> Markdown + conversion metadata, from one parse of each page; one row per URL,
    failures keep their error."""
    from webloom.operators.dom import parse_pages
    from webloom.operators.extract import page_metadata
    from webloom.operators.markdown import tree_to_markdown
    from webloom.sources.pages import fetch_batch
    fetched = fetch_batch(urls, pages).select("url", "html", "success", "error")
    parsed = parse_pages(fetched.withColumn("html", F.when(F.col("success"), F.col("html")).otherwise("")), partitions=partitions,
                         markdown=lambda tree, base: tree_to_markdown(tree, base, options))
    rows = page_metadata(parsed, nulls=True, keep=["url", "markdown", "success", "error", "parse_error"])
    meta = F.struct("source_url", "title", "description", "author", "published_date", "keywords")
    return rows.select("url", "markdown", F.when(F.col("success"), F.col("title")).alias("title"),
                       F.when(F.col("success"), meta).alias("metadata"), F.coalesce("error", "parse_error").alias("error"))


def crawl_to_markdown(seeds: DataFrame, archive: DataFrame, max_depth: int = 3, max_pages: int | None = None):
    """Crawl, then Markdown for every crawled page, converted once however many seeds reach it; plus the per-seed
    summary (A8)."""
    from webloom.operators.crawl import crawl
    from webloom.operators.markdown import to_markdown
    from webloom.sources.pages import latest_pages
    pages = crawl(seeds, archive, max_depth=max_depth, max_pages=max_pages)
    reached = latest_pages(archive.where(F.col("success")).join(pages.select("url").distinct(), "url", "left_semi"))
    md = pages.join(to_markdown(reached.select("url", "html")), "url")
    return md, crawl_summary(pages)


def crawl_summary(pages: DataFrame) -> DataFrame:
    """A8 of a crawl: pages and deepest level of each seed."""
    return pages.groupBy("seed").agg(F.count(F.lit(1)).alias("pages_crawled"), F.max("depth").alias("max_depth"))


def discovery_summary(found: DataFrame) -> DataFrame:
    """A8 of a discovery: URLs found and the methods that gave any, per site (at most three names)."""
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("total_urls"), F.array_sort(F.collect_set("method")).alias("methods_used"))


def extract(urls: DataFrame, pages: DataFrame, base_selector: str | None = None, fields: dict | None = None):
    """Fetch, then CSS records when selectors are given (base defaults to ``body``), else tables. The source markup
    goes along only if a field asks for it (type ``html``)."""
    from webloom.operators.dom import parse_pages
    from webloom.operators.extract import extract_css, extract_tables
    from webloom.sources.pages import fetch_batch
    ok = fetch_batch(urls, pages).where(F.col("success")).select("url", "html")
    if fields:
        markup = any(isinstance(f, dict) and f.get("type") == "html" for f in fields.values())
        return extract_css(parse_pages(ok, keep_html=markup), base_selector or "body", fields, keep=["url"])
    return extract_tables(parse_pages(ok), keep=["url"])


def table_requests(docs: DataFrame, key: str, text: str, schema, instruction: str | None = None, **chunking) -> DataFrame:
    """First half of C9: texts that begin with ``<`` become Markdown (X12), all are chunked into requests."""
    from webloom.operators.markdown import to_markdown
    from webloom.operators.model_batch import llm_requests
    page = F.ltrim(F.col(text)).startswith("<")
    plain = docs.where(~F.coalesce(page, F.lit(False))).select(key, F.coalesce(text, F.lit("")).alias("content"))
    pages = to_markdown(docs.where(page).select(key, F.col(text).alias("html")), base_col=None).select(key, F.col("markdown").alias("content"))
    return llm_requests(plain.unionByName(pages), key, "content", schema, instruction, **chunking)


def table_extraction(responses: DataFrame) -> DataFrame:
    """Second half of C9: model responses of the requests -> tables (L2, L3), merged by document."""
    from webloom.operators.model_batch import merge_tables, tables_from_responses
    return merge_tables(tables_from_responses(responses))


def process_pages(pages: DataFrame, fn, schema) -> DataFrame:
    """G1: user per-page function over pandas batches (``mapInPandas``), errors into an ``error`` column."""
    from pyspark.sql import types as T
    from webloom.session import ship_package
    ship_package(pages.sparkSession)
    out = T.StructType(list(schema.fields) + [T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                try:
                    r = dict(fn(rec))
                    r["error"] = None
                except Exception as e:  # noqa: BLE001
                    r = {f.name: None for f in schema.fields}
                    r["error"] = f"{type(e).__name__}: {e}"
                rows.append(r)
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields])
    return pages.mapInPandas(run, out)


def for_each_batch(pages: DataFrame, fn, checkpoint: str, trigger: dict | None = None):
    """G3 on a stream of pages: ``fn(batch, batch_id)`` for every micro-batch. A batch whose call failed, or whose commit was
    lost, comes again with its id and its rows, so a callback that keeps results by batch id counts each page once."""
    w = pages.writeStream.foreachBatch(lambda batch, batch_id: fn(batch, int(batch_id))).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def for_each_partition(pages: DataFrame, fn) -> DataFrame:
    """G3 on a table: ``fn(rows)`` gets an iterator over the rows (dicts) of each partition, in its task, and returns a number or
    nothing. One row a partition comes back, ``partition, rows, result, error``; a call that raises is a row with its
    error, and the others go on. A lost task calls again. The callback runs when the result is read."""
    from webloom.session import ship_package
    ship_package(pages.sparkSession)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext
        seen = 0

        def rows():
            nonlocal seen
            for pdf in batches:
                for rec in pdf.to_dict("records"):
                    seen += 1
                    yield rec
        result = error = None
        try:
            result = fn(rows())
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        yield pd.DataFrame({"partition": [TaskContext.get().partitionId()], "rows": [seen], "result": [None if result is None else float(result)],
                            "error": [error]})
    return pages.mapInPandas(run, "partition int, rows long, result double, error string")


def apply_strategy(parsed: DataFrame, strategy) -> DataFrame:
    """A strategy is any object with ``apply(parsed) -> DataFrame`` (or a plain function)."""
    return parsed.transform(strategy.apply if hasattr(strategy, "apply") else strategy)


def observed(df: DataFrame, name: str = "batch"):
    """Progress metrics (rows, successes) collected as the job runs, without an extra pass."""
    from pyspark.sql import Observation
    obs = Observation(name)
    succ = F.count_if(F.col("success")) if "success" in df.columns else F.lit(0)
    return df.observe(obs, F.count(F.lit(1)).alias("total"), succ.alias("succeeded")), obs
