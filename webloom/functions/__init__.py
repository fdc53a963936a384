"""Column-level functions: every function takes and returns ``pyspark.sql.Column``."""

from webloom.functions.urls import (  # noqa: F401
    netloc, site_root, resolve_url, normalize_url, link_ok, same_netloc, is_external, wiki_url,
)
from webloom.functions.text import (  # noqa: F401
    py_strip, content_hash, url_key, query_words, match_count, clean_markdown, truncate_tokens,
    cut, parse_number, cell_integer, cell_number,
)
