from webloom.operators.dom import build_tree, flatten


def tags(html):
    p = flatten(build_tree(html))
    return p


def test_unclosed_p_nests_and_script_is_raw():
    p = tags('<p><b>Hello <br>World<p>two</p><script>var t="</p>";</script>')
    assert p.tag == ["p", "b", "br", "p", "script"]
    assert p.parent == [None, 0, 1, 1, 1]
    assert p.texts == ["Hello ", "World", "two"]          # script text is not element text


def test_end_tag_pops_to_nearest_and_stray_end_ignored():
    p = tags("<div><span>a</div>b</span><i>c</i>")
    assert p.tag == ["div", "span", "i"]
    assert p.parent == [None, 0, None]
    assert p.texts == ["a", "b", "c"] and p.text_parent == [1, None, 2]


def test_void_and_self_closing_never_nest():
    p = tags("<div><img src=x><br/><input>t</div>")
    assert p.parent == [None, 0, 0, 0]
    assert p.last[0] == 3 and p.texts == ["t"]


def test_whitespace_collapse_and_entities():
    p = tags("<p>  \n  </p><p>a &amp; b</p><!-- c --><pre>  </pre>")
    assert p.texts == ["\n", "a & b", "  "]


def test_last_attribute_wins_and_offsets():
    h = '<a href="/1" href="/2">x</a><p>y'
    p = tags(h)
    assert p.avals[0] == ["/2"]
    assert h[p.s0[0]:p.s1[0]] == '<a href="/1" href="/2">x</a>'
    assert h[p.s0[1]:p.s1[1]] == "<p>y"


def test_parse_pages_columns(parse):
    r = parse("<html><body><p>x</p></body></html>").collect()[0]
    assert [n.tag for n in r.nodes] == ["html", "body", "p"]
    assert r.texts == ["x"] and r.parse_error is None


def test_a_batch_is_parsed_in_portions_of_bounded_markup(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    from webloom.operators.dom import parse_pages
    htmls = ["<p>é</p>" * 20_000, None, "", "<b>x</b>" * 60_000, "<i>z"] + ["<p>y</p>" * 5_000] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(htmls)), pa.int64()), pa.array(htmls, pa.string())], names=["page_id", "html"])

    class Pages:
        """Hands the Python stage whole batches, as Spark does."""
        sparkSession = spark
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())])

        def __init__(self, *batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            return list(run(iter(self.batches)))
    out = parse_pages(Pages(batch, batch.slice(0, 0)))
    sizes = [len("".join(htmls[i] or "" for i in b.column("page_id").to_pylist()).encode()) for b in out]
    assert all(n <= 600_000 or b.num_rows == 1 for n, b in zip(sizes, out)), sizes
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(len(htmls)))
    assert [len(r["nodes"]) for r in rows] == [20_000, 0, 0, 60_000, 1] + [5_000] * 40 and not any(r["parse_error"] for r in rows)
    nulls = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.nulls(1)], names=["page_id", "html"])
    assert parse_pages(Pages(nulls))[0].to_pylist()[0]["nodes"] == []


def test_batches_for_python_are_bounded_by_bytes_unless_the_session_states_a_bound(spark):
    import pyarrow as pa
    from webloom import session

    def sizes(rows):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in rows)
    other, stated = spark.newSession(), spark.newSession()
    for k in session.BATCH_SETTINGS:
        other.conf.unset(k)
    stated.conf.set(session.BATCH_SETTINGS[1], "77")
    for s in (other, stated):
        session.bound_batches(s)
    assert stated.conf.get(session.BATCH_SETTINGS[1]) == "77" and session.BATCH_SETTINGS[0] not in stated.conf.getAll
    pages = other.range(0, 4000, 1, 1).selectExpr("id", "repeat('<p>x</p>', 1000) AS html")
    found = [r.n for r in pages.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30e6 and max(found) < 6e6, found


def test_nothing_of_a_handed_over_portion_is_held(spark):
    import gc
    import pyarrow as pa
    from pyspark.sql import types as T
    from webloom.operators.dom import parse_pages

    class Pages:
        sparkSession = spark
        schema = T.StructType([T.StructField("html", T.StringType())])

        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_arrays([pa.array(["<p>x</p>" * 10_000] * 20)], names=["html"])]))
    gc.collect()
    start, out = pa.total_allocated_bytes(), parse_pages(Pages())
    size = next(out).nbytes
    gc.collect()
    markup = 20 * 80_000
    assert size > 2e6 and pa.total_allocated_bytes() - start < markup + size / 4


def test_plain_start_tags_are_read_at_once_and_as_the_library_reads_them(monkeypatch):
    from html.parser import HTMLParser
    from webloom.operators import dom
    by_library, quick = [], dom._Builder.parse_starttag
    read = HTMLParser.parse_starttag

    def library(self, i):
        self.plain = 0
        by_library.append(i)
        return read(self, i)
    monkeypatch.setattr(HTMLParser, "parse_starttag", library)
    plain = '<html><head><META Name="a" content="x > y"><meta property="og:k" content=""></head><body class="b"><p>t</p></body></html>'
    odd = "<a href=\"a&amp;b\">l</a><br/><i x=1><i x=\"1\"y='2'><b  c=\"d\"><script>if (a <b c=\"d\">)</script><title><p></title><textarea>\n<p></textarea><x-y z=\"1\"><p"
    for html in (plain, odd, plain + odd + plain):
        monkeypatch.setattr(dom._Builder, "parse_starttag", quick)
        by_library.clear()
        new = flatten(build_tree(html))
        assert html != plain or not by_library
        monkeypatch.setattr(dom._Builder, "parse_starttag", library)
        old = flatten(build_tree(html))
        assert all(getattr(new, f) == getattr(old, f) for f in new.__slots__)
    assert [html[a:b] for html in (plain,) for a, b in zip(flatten(build_tree(plain)).s0, flatten(build_tree(plain)).s1)][2] == '<META Name="a" content="x > y">'
