"""Extraction rules on a harbour register, a small site invented for these tests."""

from pyspark.sql import types as T

from webloom.operators import extract as X

BERTHS = """<section id=quay><article class="berth free" data-no=7><h4>North quay</h4><em>12.5 m</em><q>deep water</q></article>
<article class="berth" data-no=9><h4>Fish dock</h4><em>1,040 m</em></article>
<article class="yard" data-no=11><h4>Slipway</h4></article></section>"""


def test_css_records_with_types_and_defaults(parse):
    rows = X.extract_css(parse(BERTHS), "article.berth", {
        "place": "h4", "depth": {"selector": "em", "type": "number"}, "note": {"selector": "q", "default": "none"},
        "no": {"selector": "@", "type": "attribute", "attribute": "data-no"}}).collect()
    assert [tuple(r[c] for c in ("place", "depth", "note", "no")) for r in rows] == [
        ("North quay", 12.5, "deep water", "7"), ("Fish dock", 1040.0, "none", "9")]
    only = X.extract_css(parse(BERTHS), "article", {"place": "h4"}, multiple=False).collect()
    assert [r.place for r in only] == ["North quay"]


def test_css_combinators_and_source_markup(parse):
    page = parse(BERTHS, keep_html=True)
    out = X.extract_css(page, "#quay > .berth:not(.free) + article, article:first-child", {"h": {"selector": "h4", "type": "html"}}).collect()
    assert [r.h for r in out] == ["<h4>North quay</h4>", "<h4>Slipway</h4>"]
    out = X.extract_css(page, "article[data-no='7'] ~ article", {"t": "h4"}).collect()
    assert [r.t for r in out] == ["Fish dock", "Slipway"]


def test_xpath_paths_attributes_and_missing(parse):
    out = X.extract_xpath(parse(BERTHS), "//article[@data-no]", {
        "place": ".//h4", "depth": "./em/text()", "no": {"xpath": ".", "attribute": "data-no"},
        "note": {"xpath": "./q", "default": "?"}}).collect()
    assert [(r.place, r.depth, r.no, r.note) for r in out] == [
        ("North quay", "12.5 m", "7", "deep water"), ("Fish dock", "1,040 m", "9", "?"), ("Slipway", None, "11", "?")]


def test_xpath_positions_count_what_passes_before(parse):
    page = parse("<main><p>a</p><p class=k>b</p><i>c</i><p class=k lang=x>d</p><p lang=x>e</p><p class=k lang=x>f</p></main><p class=k>g</p>")

    def found(path):
        return [r.t for r in X.extract_xpath(page, path, {"t": "."}).collect()]
    assert found("//main/p[2]") == ["b"] and found("/main/*[3]") == ["c"]
    assert found("./main/p[@class='k'][2]") == ["d"] and found("//p[@class='k'][1]") == ["b", "g"]
    assert found("//p[@class='k'][@lang][2]") == ["f"] and found("//p[@class='k'][2][@lang]") == ["d"]
    assert found("//p[@lang][3][1]") == ["f"] and found("//p[@lang][2][2]") == []


def test_tables_with_and_without_a_head(parse):
    head = "<table><thead><tr><th>Ship</th><th>Tons</th></tr></thead><tbody><tr><td>Alba</td><td>8,200</td></tr></tbody></table>"
    r = X.extract_tables(parse(head)).first()
    assert (r.headers, r.rows) == (["Ship", "Tons"], [["Alba", "8,200"]])
    assert [c.num for c in X.table_cells(X.extract_tables(parse(head))).collect()] == [None, 8200.0]
    plain = X.extract_tables(parse("<table><tr><th>Ship</th><td>Tons</td></tr><tr><td>Brio</td><td>3</td></tr></table>")).first()
    assert (plain.headers, plain.rows) == (["Ship", "Tons"], [["Ship", "Tons"], ["Brio", "3"]])


def test_links_of_a_page(parse):
    page = parse('<a href="tides">T</a><a href="//port.test/x">P</a><a href="tel:+1">C</a><a href="#up">U</a><a href="javascript:f()">J</a>'
                 '<a title=Away href="http://sea.test/">S</a>', url="https://port.test/info/")
    rows = X.extract_links(page).collect()
    assert [(r.url, r.title, r.is_external) for r in rows] == [
        ("https://port.test/info/tides", "", False), ("https://port.test/x", "", False), ("http://sea.test/", "Away", True)]
    assert [r.url for r in X.extract_links(page, same_domain_only=True).collect()] == ["https://port.test/info/tides", "https://port.test/x"]


def test_images_need_a_source(parse):
    rows = X.extract_images(parse("<img alt=lost><img src=../map.svg width=40 alt='Harbour map'><img src='data:x'>", url="https://port.test/a/b")).collect()
    assert [(r.url, r.alt, r.width) for r in rows][0] == ("https://port.test/map.svg", "Harbour map", "40") and len(rows) == 2


def test_metadata_last_card_wins(parse):
    r = X.page_metadata(parse(
        "<head><meta name=keywords content='tide , dock,, crane'><title> Port\n</title><meta property='og:image' content=1>"
        "<meta property='og:image' content=2><meta name='twitter:site' content='@port'><meta name=author content=Mo></head>")).first()
    assert (r.title.strip(), r.author, r.og, r.twitter) == ("Port", "Mo", {"image": "2"}, {"site": "@port"})
    assert [k for k in r.keywords if k] == ["tide", "dock", "crane"]
    bare = X.page_metadata(parse("<p>nothing"), nulls=True).first()
    assert (bare.title, bare.description, bare.author, bare.keywords) == (None, None, None, [])


def test_values_beside_their_labels(parse):
    schema = T.StructType([T.StructField("captain", T.StringType(), False), T.StructField("crew", T.IntegerType(), True)])
    rows = X.extract_labels(parse("<div><span>Captain</span><b>Ines</b><span>Crew</span><b>14 hands</b></div>"), schema).collect()
    assert [(r.captain, r.crew) for r in rows] == [("Ines", 14)]


def test_deep_pages_are_linear(parse):
    import time
    from webloom.operators.dom import build_tree, flatten
    took = []
    for n in (4000, 16000):
        began = time.time()
        assert len(flatten(build_tree("<p> <i>\n</b>" * n)).tag) == 2 * n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_parse_starts_no_job_and_reads_a_stream(spark, tmp_path):
    from webloom.operators.dom import parse_pages
    spark.createDataFrame([(1, "<b>x</b>")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("parse-plan", "none")
    parse_pages(spark.read.schema("page_id long, html string").parquet(str(tmp_path / "in")))
    assert list(tracker.getJobIdsForGroup("parse-plan")) == []
    stream = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    (parse_pages(stream).select("page_id", "texts").writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    assert [r.texts for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["x"]]


def test_rendered_pages_are_dealt_out_by_rows(spark, tmp_path):
    from pyspark.sql import functions as F
    from webloom.plans.catalog import QUERIES, meta_pages
    rows = spark.range(12_001).select(F.col("id").alias("p_partkey"), F.concat(F.lit("a b"), "id").alias("p_name"), F.lit("T").alias("p_type"), F.lit("B").alias("p_brand"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tasks = meta_pages(spark, str(tmp_path)).select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(tasks) == 3 and max(r["count"] for r in tasks) <= 5_001 and sum(r["count"] for r in tasks) == 12_001
    rows.limit(0).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["page_metadata"](spark, str(tmp_path)).count() == 0


def test_repeated_properties_are_found_once(parse):
    from webloom.operators.extract import _prefixed_map
    col = _prefixed_map("property", "og:")
    assert str(col).count("property") <= 3, str(col)  # the filter and the key, not again for every entry
    out = parse("".join(f'<meta property="og:k{i % 7}" content="{i}">' for i in range(50)) + '<meta property="og:" content="x">')
    assert out.select(col.alias("m")).first().m == {f"k{i % 7}": str(i) for i in range(43, 50)}
