"""HTML extraction operators X2-X11 over the parsed DOM (see ``dom.parse_pages``).

Everything here is native Column work: ``filter``/``transform``/``aggregate`` over the node array,
``posexplode`` for one row per match.  No shuffle, no Python, whole-stage codegen around the HOFs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.common import let
from webloom.functions.text import parse_number, py_strip
from webloom.functions.urls import is_external, link_ok, netloc, resolve_url
from webloom.operators.dom import NODE_TYPE
from webloom.operators.select import Selector, bind, compile_css, compile_xpath, lower_bound



def TEXTS_():
    return F.col("texts")


def NODES_():
    return F.col("nodes")


def TPAR_():
    return F.col("text_parent")


# ----------------------------------------------------------------------------- node helpers

def text_of(el: Column, texts: Column | None = None) -> Column:
    """``get_text(strip=True)``: each text piece stripped, empties dropped, joined with ''."""
    texts = TEXTS_() if texts is None else texts
    return let(el, lambda e: F.when(e.isNotNull(), F.array_join(F.filter(
        F.transform(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), py_strip), lambda x: x != ""), "")))


def raw_text_of(el: Column, texts: Column | None = None) -> Column:
    """All descendant text concatenated as is (XPath string value)."""
    texts = TEXTS_() if texts is None else texts
    return let(el, lambda e: F.when(e.isNotNull(), F.array_join(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), "")))


def descendants(el: Column, nodes: Column | None = None) -> Column:
    nodes = NODES_() if nodes is None else nodes
    return let(el, lambda e: F.slice(nodes, e["id"] + 2, e["last"] - e["id"]))


def first(arr: Column) -> Column:
    return F.get(arr, 0)


def find_all(pred, nodes: Column | None = None) -> Column:
    nodes = NODES_() if nodes is None else nodes
    return F.filter(nodes, lambda n: F.coalesce(pred(n), F.lit(False)))


def find(pred, nodes: Column | None = None) -> Column:
    nodes = NODES_() if nodes is None else nodes
    return first(find_all(pred, nodes))


def find_in(el: Column, pred, nodes: Column | None = None) -> Column:
    nodes = NODES_() if nodes is None else nodes
    return first(F.filter(descendants(el, nodes), lambda n: F.coalesce(pred(n), F.lit(False))))


def hit_ids(pred, tree) -> Column:
    """Ids of the nodes that pass, in document order."""
    return F.transform(F.filter(tree.nodes, lambda n: F.coalesce(pred(n, tree), F.lit(False))), lambda n: n["id"])


def first_between(ascending: Column, low: Column, high: Column) -> Column:
    """The first number of a sorted array in ``[low, high]``, null if there is none; a binary search."""
    return let(F.get(ascending, lower_bound(ascending, low)), lambda i: F.when(i <= high, i))


def tag_is(*tags):
    return lambda n: n["tag"].isin(*tags)


def _truthy(v: Column, dtype: str) -> Column:
    return v.isNotNull() & ((v != 0) if dtype == "double" else (v != ""))


# ----------------------------------------------------------------------------- X2 CSS records

@dataclass
class Field:
    """One output field of a CSS record: selector (``@`` = the base element itself), type in
    text / html / attribute / number (anything else reads as text), attribute name, a Column->Column
    ``transform`` applied to truthy values only, and a default for missing elements."""
    selector: str
    type: str = "text"
    attribute: str | None = None
    transform: Callable[[Column], Column] | None = None
    default: object = None

    @staticmethod
    def of(cfg) -> "Field":
        if isinstance(cfg, Field):
            return cfg
        if isinstance(cfg, str):
            return Field(cfg)
        return Field(**cfg)


def _css_value(f: Field, el: Column, html: Column | None) -> Column:
    dtype = "double" if f.type == "number" else "string"
    default = F.lit(f.default).cast(dtype)
    if f.type == "html" and html is None:
        raise ValueError("field type 'html' needs parse_pages(..., keep_html=True)")
    if f.type == "html":
        v = F.substring(html, el["s0"] + 1, el["s1"] - el["s0"])
    elif f.type == "attribute":
        v = F.coalesce(el["attrs"].getItem(f.attribute or ""), default)
    elif f.type == "number":
        v = parse_number(text_of(el), f.default)
    else:
        v = text_of(el)
    if f.transform is not None:
        v = let(v, lambda x: F.when(_truthy(x, dtype), f.transform(x)).otherwise(x))
    return F.when(el.isNull(), default).otherwise(v)


def _records(parsed: DataFrame, base: Selector, fields: dict, value, keep: list[str] | None, multiple: bool = True) -> DataFrame:
    """One row per base element. ``fields``: name -> Selector, or None for the base itself; ``value(name, element)`` reads it.

    Every selector runs over the nodes of a page once; a base finds its first hit by binary search in the sorted ids.
    For a relative path of several steps the hits of the last step inside the base are tested, up to all of them."""
    sought = {k: s for k, s in fields.items() if s is not None}

    def page(tree):
        bases = find_all(lambda n: base.pred(n, tree), tree.nodes)
        bases = bases if multiple else F.slice(bases, 1, 1)
        if not sought:
            return F.transform(bases, lambda b: record(None, b, tree))
        ids = F.struct(*[hit_ids(s.pred or s.own, tree).alias(k) for k, s in sought.items()])
        return let(ids, lambda h: F.transform(bases, lambda b: record(h, b, tree)))

    def record(h, b, tree):
        def read(k, s):
            if s is None:
                return value(k, b).alias(k)
            return let(F.get(tree.nodes, hit(s, h[k], b, tree)), lambda el: value(k, el)).alias(k)
        return F.struct(*[read(k, s) for k, s in fields.items()])

    def hit(s, ids, b, tree):
        if s.chain is None:
            return first(ids) if s.document else first_between(ids, b["id"] + 1, b["last"])
        if s.inside:
            return first_between(ids, b["id"] + 1, b["last"])
        start = lower_bound(ids, b["id"] + 1)
        inside = let(start, lambda lo: F.slice(ids, lo + 1, lower_bound(ids, b["last"] + 1) - lo))
        return first(F.filter(inside, lambda i: F.coalesce(let(F.get(tree.nodes, i), lambda n: s.chain(n, tree, b)), F.lit(False))))

    rec = bind([x for s in (base, *sought.values()) for x in s.siblings], NODES_(), page)
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    return (parsed.select(*keep, F.posexplode(rec).alias("pos", "r"))
            .select(*keep, "pos", *[F.col("r")[n].alias(n) for n in fields]))


def extract_css(parsed: DataFrame, base_selector: str, fields: dict, multiple: bool = True,
                keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """One row per base element (all, or the first when ``multiple=False``), one column per field."""
    fields = {k: Field.of(v) for k, v in fields.items()}
    html = F.col(html_col) if html_col in parsed.columns else None
    selectors = {k: None if f.selector.startswith("@") else compile_css(f.selector) for k, f in fields.items()}
    return _records(parsed, compile_css(base_selector), selectors, lambda k, el: _css_value(fields[k], el, html), keep, multiple)


# ----------------------------------------------------------------------------- X4 XPath records

def _xpath_value(terminal: tuple | None, attr: str | None, default, el: Column) -> Column:
    dflt = F.lit(default).cast("string")
    if terminal and terminal[0] == "attr":
        v = el["attrs"].getItem(terminal[1])
    elif terminal and terminal[0] == "text":
        own = F.filter(F.sequence(el["t0"], F.greatest(el["t1"] - 1, el["t0"])),
                       lambda i: (i < el["t1"]) & (F.get(TPAR_(), i) == el["id"]))
        v = F.get(TEXTS_(), first(own))
    else:
        v = F.when(el.isNotNull(), el["attrs"].getItem(attr) if attr else py_strip(raw_text_of(el)))
        return F.when(el.isNotNull(), v).otherwise(dflt)
    return let(v, lambda x: F.when(x.isNotNull(), x if attr else py_strip(x)).otherwise(dflt))


def extract_xpath(parsed: DataFrame, base_xpath: str, fields: dict, namespaces: dict | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """Base nodes by XPath; per field the first hit: attribute, else trimmed string value;
    missing -> the field default. Pages are HTML, whose tree has no namespaces: a qualified name is matched as it is
    written (``svg:path``), and a non-empty ``namespaces`` is refused, since nothing could be resolved by it."""
    if namespaces:
        raise ValueError("HTML has no namespaces: write the prefix as part of the name")
    base = compile_xpath(base_xpath, document=True)
    if base.pred is None or base.terminal:
        raise ValueError("the base XPath must select elements")
    fields = {k: {"xpath": c} if isinstance(c, str) else c for k, c in fields.items()}
    paths = {k: compile_xpath(c.get("xpath", c.get("selector", "."))) for k, c in fields.items()}
    return _records(parsed, base, {k: p if p.pred or p.own else None for k, p in paths.items()},
                    lambda k, el: _xpath_value(paths[k].terminal, fields[k].get("attribute"), fields[k].get("default"), el), keep)


# ----------------------------------------------------------------------------- X5 label/value

LABEL_CONTAINERS = ("div", "article", "section", "li")


def _label_value(el: Column, hits: Column, dtype: T.DataType) -> Column:
    def from_hit(ti):
        txt = F.get(TEXTS_(), ti)
        par = F.get(NODES_(), F.get(TPAR_(), ti))
        return let(F.struct(txt.alias("txt"), par.alias("par")), lambda r: from_parent(r["txt"], r["par"]))

    def from_parent(txt, par):
        # the parent's next sibling: a non-blank text before the next element sibling, else that element
        nxt = F.get(NODES_(), par["next"])
        grand = F.get(NODES_(), par["parent"])
        stop = F.coalesce(nxt["t0"], grand["t1"], F.size(TEXTS_()))
        sib = F.filter(F.sequence(par["t1"], F.greatest(stop - 1, par["t1"])),
                       lambda i: (i < stop)
                       & (F.coalesce(F.get(TPAR_(), i), F.lit(-1)) == F.coalesce(par["parent"], F.lit(-1)))
                       & (py_strip(F.get(TEXTS_(), i)) != ""))
        sib_text = F.get(TEXTS_(), first(sib))
        return (F.when(par.isNull(), py_strip(txt))
                .when(sib_text.isNotNull(), py_strip(sib_text))
                .when(nxt.isNotNull(), text_of(nxt))
                .otherwise(py_strip(txt)))

    value = let(first_between(hits, el["t0"], el["t1"] - 1), lambda ti: F.when(ti.isNotNull(), from_hit(ti)))
    if isinstance(dtype, T.StringType):
        return value
    num = F.replace(F.regexp_extract(value, r"[\d,]+\.?\d*", 0), F.lit(","), F.lit(""))
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return num.try_cast(dtype)
    return num.try_cast("double").cast(dtype)


def extract_labels(parsed: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """For every div/article/section/li, each field is the text next to the first text that
    matches the field name (case-insensitive); rows missing a non-nullable field are dropped. A page's texts are tested
    once a field; a container finds its first hit by binary search."""
    names = [re.compile(f.name).pattern for f in schema.fields]
    places = F.filter(F.sequence(F.lit(0), F.size(TEXTS_())), lambda i: i < F.size(TEXTS_()))

    def naming(pattern):
        return F.filter(places, lambda i: F.get(TEXTS_(), i).rlike("(?i)" + pattern))
    hits = [naming(n).alias(f"f{k}") for k, n in enumerate(names)]
    rec = let(F.struct(*hits), lambda h: F.transform(find_all(tag_is(*LABEL_CONTAINERS)), lambda e: F.struct(
        *[_label_value(e, h[f"f{k}"], f.dataType).alias(f.name) for k, f in enumerate(schema.fields)])))
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    out = (parsed.select(*keep, F.posexplode(rec).alias("pos", "r"))
           .select(*keep, "pos", *[F.col("r")[f.name].alias(f.name) for f in schema.fields]))
    any_field = None
    for f in schema.fields:
        c = F.col(f.name).isNotNull()
        any_field = c if any_field is None else (any_field | c)
    out = out.where(any_field)
    for f in schema.fields:
        if not f.nullable:
            out = out.where(F.col(f.name).isNotNull())
    return out


# ----------------------------------------------------------------------------- X6/X7 tables

def _cells(row: Column) -> Column:
    return F.filter(descendants(row), tag_is("td", "th"))


def table_struct(t: Column) -> Column:
    def head(h):
        thead, first_row = h["thead"], h["first_row"]
        return F.when(thead.isNotNull(), F.filter(descendants(thead), tag_is("th"))) \
            .when(first_row.isNotNull(), _cells(first_row)).otherwise(F.array().cast(T.ArrayType(NODE_TYPE)))

    head_cells = let(F.struct(find_in(t, tag_is("thead")).alias("thead"), find_in(t, tag_is("tr")).alias("first_row")), head)
    headers = F.transform(head_cells, lambda c: text_of(c))
    body = F.coalesce(find_in(t, tag_is("tbody")), t)
    rows = F.filter(F.transform(F.filter(descendants(body), tag_is("tr")),
                                lambda r: F.transform(_cells(r), lambda c: text_of(c))),
                    lambda r: F.size(r) > 0)
    return F.struct(t["id"].alias("node_id"), headers.alias("headers"), rows.alias("rows"))


def extract_tables(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keys, table_idx, node_id, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>).

    Without <thead> the header row is also a data row; nested tables' rows belong to the outer one
    as well; a table is kept when it has headers or rows."""
    tables = F.filter(F.transform(find_all(tag_is("table")), table_struct),
                      lambda s: (F.size(s["headers"]) > 0) | (F.size(s["rows"]) > 0))
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    return (parsed.select(*keep, F.posexplode(tables).alias("table_idx", "t"))
            .select(*keep, "table_idx", "t.node_id", "t.headers", "t.rows"))


def table_cells(tables: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """X7 long form: one row per data cell with ``raw`` text, ``num`` (NULL when not a number) and ``num_int``, the exact
    value of an integer."""
    from webloom.functions.text import cell_integer, cell_number
    keep = keep or [c for c in ("page_id", "url") if c in tables.columns]
    return (tables.select(*keep, "table_idx", F.posexplode("rows").alias("row_idx", "row"))
            .select(*keep, "table_idx", "row_idx", F.posexplode("row").alias("col_idx", "raw"))
            .withColumn("num", cell_number("raw")).withColumn("num_int", cell_integer("raw")))


# ----------------------------------------------------------------------------- X8 links, X9 images

def extract_links(parsed: DataFrame, base: str | Column | None = "url", same_domain_only: bool = False,
                  keep: list[str] | None = None) -> DataFrame:
    """``a[href]`` in document order -> (page_id, src_url, pos, url, text, title, is_external)."""
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    base_c = None if base is None else (F.col(base) if isinstance(base, str) else base)
    anchors = find_all(lambda n: (n["tag"] == "a") & n["attrs"].getItem("href").isNotNull())
    rec = F.transform(anchors, lambda a: F.struct(
        a["attrs"].getItem("href").alias("href"), text_of(a).alias("text"),
        F.coalesce(a["attrs"].getItem("title"), F.lit("")).alias("title")))
    base_cols = [] if base_c is None else [base_c.alias("_base")]
    df = parsed.select(*keep, *base_cols, F.posexplode(rec).alias("pos", "l")).where(link_ok(F.col("l.href")))
    href = F.col("l.href")
    if base_c is None:
        link = href
        ext = F.lit(True)
    else:
        b = F.col("_base")
        link = F.when(b.isNotNull() & (b != "") & ~href.startswith("http://") & ~href.startswith("https://"),
                      resolve_url(b, href)).otherwise(href)
    df = df.withColumn("link", link)
    if base_c is not None:
        ext = is_external(F.col("link"), F.col("_base"))
        if same_domain_only:
            bn = netloc(F.col("_base"))
            df = df.where((bn == "") | (netloc(F.col("link")) == bn))
    keys = [F.col(k).alias("src_url") if k == "url" else F.col(k) for k in keep]
    return df.select(*keys, "pos", F.col("link").alias("url"), F.col("l.text").alias("text"),
                     F.col("l.title").alias("title"), ext.alias("is_external"))


def extract_images(parsed: DataFrame, base: str | Column | None = "url", keep: list[str] | None = None) -> DataFrame:
    """``img`` with a non-empty src -> (page_id, src_url, pos, url, alt, title, width, height)."""
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    base_c = None if base is None else (F.col(base) if isinstance(base, str) else base)
    imgs = find_all(lambda n: (n["tag"] == "img") & (F.coalesce(n["attrs"].getItem("src"), F.lit("")) != ""))
    a = lambda k, d=None: F.coalesce(F.col("i.attrs").getItem(k), F.lit(d)) if d is not None else F.col("i.attrs").getItem(k)
    base_cols = [] if base_c is None else [base_c.alias("_base")]
    df = parsed.select(*keep, *base_cols, F.posexplode(imgs).alias("pos", "i"))
    src = a("src")
    if base_c is not None:
        b = F.col("_base")
        src = F.when(b.isNotNull() & (b != "") & ~src.startswith("http://") & ~src.startswith("https://")
                     & ~src.startswith("data:"), resolve_url(b, src)).otherwise(src)
    keys = [F.col(k).alias("src_url") if k == "url" else F.col(k) for k in keep]
    return df.select(*keys, "pos", src.alias("url"), a("alt", "").alias("alt"), a("title", "").alias("title"),
                     a("width").alias("width"), a("height").alias("height"))


# ----------------------------------------------------------------------------- X10/X11 metadata

def _meta_content(names, nodes: Column | None = None) -> Column:
    """First non-empty content over ``names``; per name the first meta by @name, else by @property."""
    nodes = NODES_() if nodes is None else nodes
    out = None
    for nm in names:
        m = F.coalesce(find(lambda n: (n["tag"] == "meta") & (n["attrs"].getItem("name") == nm), nodes),
                       find(lambda n: (n["tag"] == "meta") & (n["attrs"].getItem("property") == nm), nodes))
        c = let(m["attrs"].getItem("content"), lambda x: F.when(x != "", x))
        out = c if out is None else F.coalesce(out, c)
    return out


def _prefixed_map(attr: str, prefix: str, nodes: Column | None = None) -> Column:
    """Property -> content for metas whose ``attr`` starts with prefix; prefix removed
    everywhere in the name (as ``str.replace``); empty names dropped; the last duplicate wins."""
    nodes = NODES_() if nodes is None else nodes
    metas = F.filter(nodes, lambda n: (n["tag"] == "meta") & F.coalesce(n["attrs"].getItem(attr).startswith(prefix), F.lit(False)))
    entries = F.filter(F.transform(metas, lambda n: F.struct(
        F.replace(n["attrs"].getItem(attr), F.lit(prefix), F.lit("")).alias("key"),
        F.coalesce(n["attrs"].getItem("content"), F.lit("")).alias("value"))), lambda e: e["key"] != "")
    def last_wins(es):
        return F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.greatest(F.size(es) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(let(entries, last_wins))


def _keywords(nodes: Column | None = None, missing: Column | None = None) -> Column:
    nodes = NODES_() if nodes is None else nodes
    kw = find(lambda n: (n["tag"] == "meta") & (n["attrs"].getItem("name") == "keywords"), nodes)
    return let(kw, lambda k: F.when(k.isNotNull(), F.transform(
        F.split(F.coalesce(k["attrs"].getItem("content"), F.lit("")), ",", -1), py_strip))
        .otherwise(F.array().cast("array<string>")))


def page_metadata(parsed: DataFrame, nulls: bool = False, keep: list[str] | None = None) -> DataFrame:
    """X10 (``nulls=False``): title, description, keywords, author, og, twitter with '' defaults.
    X11 (``nulls=True``): source_url, title, description, author, published_date, keywords; NULL when absent."""
    keep = keep or [c for c in ("page_id", "url") if c in parsed.columns]
    title_el = find(tag_is("title"))
    title = text_of(title_el)
    desc = _meta_content(["description", "og:description", "twitter:description"])
    author = _meta_content(["author", "og:author"])
    if nulls:
        return parsed.select(
            *keep, F.col("url").alias("source_url"), title.alias("title"), desc.alias("description"),
            author.alias("author"),
            _meta_content(["published_date", "article:published_time", "datePublished"]).alias("published_date"),
            _keywords().alias("keywords"))
    e = F.lit("")
    return parsed.select(
        *keep, F.coalesce(title, e).alias("title"), F.coalesce(desc, e).alias("description"),
        _keywords().alias("keywords"), F.coalesce(author, e).alias("author"),
        _prefixed_map("property", "og:").alias("og"), _prefixed_map("name", "twitter:").alias("twitter"))
