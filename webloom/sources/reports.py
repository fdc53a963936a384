"""Result report sink (S11): render each search answer document as markdown, html or json text.

Per row (one answer per row), native string functions only; write with ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEMS = "struct<results: array<struct<title: string, url: string, href: string, content: string, text: string>>>"


def _items(payload: Column) -> Column:
    return F.coalesce(F.from_json(payload, _ITEMS)["results"], F.array().cast(
        "array<struct<title: string, url: string, href: string, content: string, text: string>>"))


def render_results(answers: DataFrame, fmt: str = "markdown", query: str = "query", payload: str = "payload",
                   shown: int | None = None, chars: int | None = None) -> DataFrame:
    """-> answers + ``report``.  Items: title (default 'Untitled'), url = href else url else '#', content = content else
    text else ''. ``shown`` limits the items of a report, ``chars`` cuts each content and adds '...'."""
    items = _items(F.col(payload))
    top = items if shown is None else F.slice(items, 1, shown)
    q = F.col(query)

    def fields(x):
        title = F.coalesce(x["title"], F.lit("Untitled"))
        url = F.coalesce(x["href"], x["url"], F.lit("#"))
        content = F.coalesce(x["content"], x["text"], F.lit(""))
        if chars is not None:
            content = F.concat(F.substring(content, 1, chars), F.lit("..."))
        return title, url, content

    if fmt == "json":
        report = F.col(payload)
    elif fmt == "html":
        def block(x):
            t, u, c = fields(x)
            return F.concat(F.lit('<div class="result">\n<h3><a href="'), u, F.lit('">'), t, F.lit("</a></h3>\n<p>"),
                            c, F.lit("</p>\n<small>"), u, F.lit("</small>\n</div>"))
        head = F.concat(F.lit("<h1>Search Results for: "), q, F.lit("</h1>"))
        report = F.when(F.size(top) > 0, F.concat(head, F.lit("\n"), F.array_join(F.transform(top, block), "\n"))).otherwise(head)
    else:
        def section(x, i):
            t, u, c = fields(x)
            return F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), t, F.lit("\n**URL:** "), u,
                            F.lit("\n\n"), c, F.lit("\n"))
        head = F.concat(F.lit("# Search Results for: "), q, F.lit("\n\nFound "), F.size(items).cast("string"),
                        F.lit(" results\n"))
        report = F.when(F.size(top) > 0, F.concat(head, F.lit("\n"), F.array_join(F.transform(top, section), "\n"))) \
            .otherwise(head)
    return answers.withColumn("report", report)
