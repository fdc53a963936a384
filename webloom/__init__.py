"""webloom: web-corpus search and extraction as Spark DataFrame / SQL / Structured Streaming jobs.

Subpackages
-----------
sources    scans and sinks: page archives, search-engine feeds, sitemaps, robots files, snapshots, reports
functions  Column-level scalar functions (URLs, text, block/retry classification)
operators  DataFrame -> DataFrame operators (DOM parse, extraction, markdown, search ranking,
           discovery, crawl, change detection, fetch-log windows, model-batch I/O)
plans      composite jobs built from the operators (search, crawl, discover, scrape, extract, ...)
streaming  Structured Streaming jobs (change monitor, sliding request rates)
"""

__version__ = "0.1.0"
