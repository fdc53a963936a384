import json

from webloom.plans.jobs import search


def test_feeds_dedupe_rank_and_answer(spark):
    w = json.dumps({"results": [{"title": "Cats guide", "url": "https://a.edu/cats/"}, {"href": "http://b.com", "body": "x"}]})
    b = json.dumps({"webPages": {"value": [{"name": "Dup", "url": "HTTPS://A.EDU/cats"}]}})
    d = ('<table><tr class="result"><td><a class="result-link" href="https://c.com">C cats</a></td>'
         '<td class="result-snippet">about cats</td></tr><tr class="result"><td>no link</td></tr></table>')
    k = json.dumps({"query": {"search": [{"title": "Dog house", "snippet": '<span class="searchmatch">dog</span> x'}]}})
    feeds = spark.createDataFrame([("cats", "whoogle", 0, w), ("cats", "bing", 0, b), ("cats", "duckduckgo", 0, d),
                                   ("cats", "wikipedia", 0, k), ("dogs", "wikipedia", 0, k), ("dogs", "bing", 0, "oops")],
                                  "query string, engine string, doc_no long, payload string")
    top, ans = search(feeds, 10)
    got = [(r.url, r.engine, round(r.score, 4)) for r in top.where("query = 'cats'").orderBy("rank").collect()]
    assert got == [("https://a.edu/cats/", "whoogle", 1.0), ("https://c.com", "duckduckgo", 0.92),
                   ("http://b.com", "whoogle", 0.9)]
    a = {r.query: r for r in ans.collect()}
    assert a["cats"].engines_used == ["whoogle", "duckduckgo", "bing"] and a["cats"].total_results == 3
    assert a["dogs"].engines_used == ["wikipedia"] and a["dogs"].errors == ["Bing: invalid payload"]
    dog = top.where("query = 'dogs'").collect()[0]
    assert dog.title == "Dog house - Wikipedia" and dog.url == "https://en.wikipedia.org/wiki/Dog_house"


def test_render_results(spark):
    from webloom.sources.reports import render_results
    p = json.dumps({"results": [{"title": "A", "href": "https://a", "content": "x" * 400}, {"url": "https://b"}]})
    df = spark.createDataFrame([("q", p)], "query string, payload string")
    md = render_results(df, "markdown", shown=10, chars=300).collect()[0].report
    assert md.startswith("# Search Results for: q\n\nFound 2 results\n\n## 1. A\n**URL:** https://a\n\n" + "x" * 300 + "...\n")
    assert "## 2. Untitled\n**URL:** https://b\n\n...\n" in md
    html = render_results(df, "html", shown=1, chars=300).collect()[0].report
    assert html.startswith('<h1>Search Results for: q</h1>\n<div class="result">\n<h3><a href="https://a">A</a></h3>')
    assert html.count("<h3>") == 1 and render_results(df, "json").first().report == p
    assert "x" * 400 + "\n" in render_results(df).first().report  # nothing is cut unless asked


def test_feed_limits_are_asked_for(spark):
    from webloom.sources.feeds import USUAL_LIMITS, read_feed
    rows = "".join(f'<tr class="result"><td><a class="result-link" href="https://c.test/{i}">{"t" * 250}</a></td></tr>' for i in range(14))
    feed = spark.createDataFrame([("q", "duckduckgo", 0, f"<table>{rows}</table>")], "query string, engine string, doc_no long, payload string")
    assert read_feed(feed).count() == 14 and len(read_feed(feed).first().title) == 250
    cut = read_feed(feed, limits=USUAL_LIMITS)
    assert cut.count() == 10 and len(cut.first().title) == 200
