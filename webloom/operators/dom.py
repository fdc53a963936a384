"""Parse pages once into a columnar DOM.

Each page becomes::

    texts        ARRAY<STRING>  text nodes in document order (whitespace-only ones collapsed to ' ' or '\\n')
    text_parent  ARRAY<INT>     element id holding each text (null at top level)
    nodes        ARRAY<STRUCT<id, parent, prev, next, idx, last, depth, tag, attrs, t0, t1, s0, s1>>

Ids are pre-order positions, so ``nodes[id]`` is an O(1) lookup (``F.get``), the descendants of an
element are exactly ids ``id+1 .. last``, and its text is ``texts[t0 .. t1)``.  ``s0/s1`` are code-point
offsets of the element's source markup (outer HTML = ``substring(html, s0+1, s1-s0)``).
``prev``/``next`` are the neighbouring element siblings, ``idx`` the 1-based position among them.

Tree rules are those of a lenient non-HTML5 builder: no optional-tag auto-closing (an unclosed ``<p>``
nests the next one), an end tag closes up to the nearest open element of that name or is ignored,
void elements never nest, script/style/template strings, comments and doctype are not element text.

This is the only Python stage; every extractor downstream is native Column work over these arrays.
"""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements that never take children, and containers whose strings are not element text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split())
NON_TEXT_CONTAINERS = frozenset(["script", "style", "template"])
PRESERVE_WS = frozenset(["pre", "textarea"])
_ASCII_SPACES = str.maketrans("", "", "\x20\x0a\x09\x0c\x0d")


#: A start tag written plainly: one space before each attribute, values in double quotes and without references.
_PLAIN_TAG = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z:_-]*="[^"&]*")*)>')
_PLAIN_ATTR = re.compile(r' ([a-zA-Z][a-zA-Z:_-]*)="([^"&]*)"')
#: Elements whose content the standard library's parser reads by rules of their own.
_RAW_TAGS = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


class Elem:
    __slots__ = ("tag", "attrs", "children", "s0", "s1")

    def __init__(self, tag, attrs, s0):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.s0 = s0
        self.s1 = s0


class Text(str):
    """A text child; ``plain`` is False for script/style/template content."""
    __slots__ = ("plain",)


def _text(s, plain):
    t = Text(s)
    t.plain = plain
    return t


class _Builder(HTMLParser):
    def __init__(self, src: str):
        super().__init__(convert_charrefs=True)
        self.src = src
        self._lines = [0]
        i = src.find("\n")
        while i >= 0:
            self._lines.append(i + 1)
            i = src.find("\n", i + 1)
        self.root = Elem("[document]", {}, 0)
        self.stack = [self.root]
        self.preserving = 0   # open pre/textarea elements
        self.open_tags = {}   # open elements by tag: an end tag without one is ignored at once
        self.pending = []
        self.plain = 0        # length of the start tag at hand, if it is a plain one

    def parse_starttag(self, i):
        """Plain start tags by two expressions, which give what the library's steps give; all others by the library."""
        m = _PLAIN_TAG.match(self.rawdata, i)
        tag = m.group(1).lower() if m else ""
        if not m or tag in _RAW_TAGS:
            self.plain = 0
            return super().parse_starttag(i)
        self.plain = m.end() - i
        self.lasttag = tag
        found = _PLAIN_ATTR.findall(m.group(2)) if m.group(2) else ()
        self.handle_starttag(tag, [(k.lower(), v) for k, v in found])
        return m.end()

    def _pos(self) -> int:
        line, col = self.getpos()
        return self._lines[line - 1] + col

    def _flush(self):
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if data.translate(_ASCII_SPACES) == "" and not self.preserving:
            data = "\n" if "\n" in data else " "
        cur = self.stack[-1]
        cur.children.append(_text(data, cur.tag not in NON_TEXT_CONTAINERS))

    def _open(self, tag, attrs):
        self._flush()
        d = {}
        for k, v in attrs:
            d[k] = "" if v is None else v          # a repeated attribute: the last one wins
        start = self._pos()
        e = Elem(tag, d, start)
        e.s1 = start + (self.plain or len(self.get_starttag_text() or ""))
        self.stack[-1].children.append(e)
        return e

    def handle_starttag(self, tag, attrs):
        e = self._open(tag, attrs)
        if tag not in VOID_TAGS:
            self.stack.append(e)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
            self.preserving += tag in PRESERVE_WS

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        self._flush()
        if tag in VOID_TAGS or not self.open_tags.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                start = self._pos()
                gt = self.src.find(">", start)
                end = len(self.src) if gt < 0 else gt + 1
                for e in self.stack[i + 1:]:
                    e.s1 = start
                self.stack[i].s1 = end
                for e in self.stack[i:]:
                    self.open_tags[e.tag] -= 1
                    self.preserving -= e.tag in PRESERVE_WS
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def finish(self) -> Elem:
        self.close()
        self._flush()
        for e in self.stack[1:]:
            e.s1 = len(self.src)
        return self.root


def build_tree(html: str) -> Elem:
    b = _Builder(html or "")
    b.feed(html or "")
    return b.finish()


class _PageNodes:
    __slots__ = ("texts", "text_parent", "parent", "prev", "next", "idx", "last", "depth", "tag",
                 "akeys", "avals", "t0", "t1", "s0", "s1")

    def __init__(self):
        for f in self.__slots__:
            setattr(self, f, [])


def flatten(root: Elem) -> _PageNodes:
    """Pre-order numbering of the element tree (iterative: unclosed tags nest arbitrarily deep)."""
    out = _PageNodes()
    texts, tpar = out.texts, out.text_parent

    above = []  # of the open elements: what is left of their children, and their state
    children, my_id, depth, prev_sib, k = iter(root.children), None, 0, None, 0
    while True:
        for ch in children:
            if isinstance(ch, Elem):
                k += 1
                nid = len(out.tag)
                out.tag.append(ch.tag)
                out.parent.append(my_id)
                out.prev.append(prev_sib)
                out.next.append(None)
                if prev_sib is not None:
                    out.next[prev_sib] = nid
                out.idx.append(k)
                out.depth.append(depth)
                out.akeys.append(list(ch.attrs.keys()))
                out.avals.append(list(ch.attrs.values()))
                out.t0.append(len(texts))
                out.t1.append(len(texts))
                out.last.append(nid)
                out.s0.append(ch.s0)
                out.s1.append(ch.s1)
                prev_sib = nid
                if ch.children:
                    above.append((children, my_id, depth, prev_sib, k))
                    children, my_id, depth, prev_sib, k = iter(ch.children), nid, depth + 1, None, 0
                    break
            elif ch.plain:
                texts.append(str(ch))
                tpar.append(my_id)
        else:
            if my_id is None:
                return out
            out.t1[my_id] = len(texts)
            out.last[my_id] = len(out.tag) - 1
            children, my_id, depth, prev_sib, k = above.pop()


NODE_TYPE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("prev", T.IntegerType()), T.StructField("next", T.IntegerType()),
    T.StructField("idx", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t0", T.IntegerType()), T.StructField("t1", T.IntegerType()),
    T.StructField("s0", T.IntegerType()), T.StructField("s1", T.IntegerType()),
])
DOM_FIELDS = [
    T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("text_parent", T.ArrayType(T.IntegerType())),
    T.StructField("nodes", T.ArrayType(NODE_TYPE)),
    T.StructField("parse_error", T.StringType()),
]

_I32 = pa.int32()
_ARROW_NODE = pa.struct([
    ("id", _I32), ("parent", _I32), ("prev", _I32), ("next", _I32), ("idx", _I32), ("last", _I32),
    ("depth", _I32), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("t0", _I32), ("t1", _I32), ("s0", _I32), ("s1", _I32)])


def _dom_arrays(htmls, bases, markdown=None):
    """Parse a batch of pages into the four Arrow columns, and their Markdown if asked for."""
    cols = {k: [] for k in _PageNodes.__slots__}
    page_off, text_off, attr_off = [0], [0], [0]
    errors, mds = [], []
    for h, base_url in zip(htmls, bases):
        err, md = None, ""
        try:
            tree = build_tree(h or "")
            p = flatten(tree)
            md = markdown(tree, base_url) if markdown else ""
        except Exception as e:  # a broken page yields an empty DOM and an error, never a failed job
            p, err = _PageNodes(), f"{type(e).__name__}: {e}"
        errors.append(err)
        mds.append(md)
        n = len(p.tag)
        base = len(cols["tag"])
        for f in ("parent", "prev", "next", "idx", "last", "depth", "tag", "t0", "t1", "s0", "s1"):
            cols[f].extend(getattr(p, f))
        for ks, vs in zip(p.akeys, p.avals):
            cols["akeys"].extend(ks)
            cols["avals"].extend(vs)
            attr_off.append(attr_off[-1] + len(ks))
        cols["texts"].extend(p.texts)
        cols["text_parent"].extend(p.text_parent)
        page_off.append(base + n)
        text_off.append(len(cols["texts"]))
    n_nodes = len(cols["tag"])
    ids = []
    for i in range(len(page_off) - 1):
        ids.extend(range(page_off[i + 1] - page_off[i]))
    attrs = pa.MapArray.from_arrays(pa.array(attr_off, _I32), pa.array(cols["akeys"], pa.string()),
                                    pa.array(cols["avals"], pa.string()))
    fields = [pa.array(ids, _I32)] + [pa.array(cols[f], _I32) for f in ("parent", "prev", "next", "idx", "last", "depth")]
    fields += [pa.array(cols["tag"], pa.string()), attrs]
    fields += [pa.array(cols[f], _I32) for f in ("t0", "t1", "s0", "s1")]
    assert all(len(a) == n_nodes for a in fields)
    node_struct = pa.StructArray.from_arrays(fields, fields=list(_ARROW_NODE))
    nodes = pa.ListArray.from_arrays(pa.array(page_off, _I32), node_struct)
    t_off = pa.array(text_off, _I32)
    texts = pa.ListArray.from_arrays(t_off, pa.array(cols["texts"], pa.string()))
    tpar = pa.ListArray.from_arrays(t_off, pa.array(cols["text_parent"], _I32))
    return texts, tpar, nodes, pa.array(errors, pa.string()), pa.array(mds, pa.string())


PORTION_BYTES = 1 << 19  # markup whose nodes a task holds as Python objects at a time


def _portions(batch: pa.RecordBatch, html_col: str):
    """Slices of ``batch`` with at most ``PORTION_BYTES`` of markup, or one larger page. Nodes of a page take some hundred
    times its markup while they are Python objects, and a batch holds whole pages by number, whatever their size."""
    start = held = 0
    markup = batch.column(html_col)
    markup = markup.cast(pa.string()) if pa.types.is_null(markup.type) else markup
    for i, n in enumerate(pc.binary_length(markup).to_pylist()):
        n = n or 0
        if i > start and held + n > PORTION_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def parse_pages(pages: DataFrame, html_col: str = "html", keep_html: bool = False, partitions: int | None = None,
                markdown=None) -> DataFrame:
    """Append ``texts, text_parent, nodes, parse_error`` to every page row (one Arrow pass; no job is started here,
    and a stream can be parsed).

    Filter and project *before* calling this: the Python stage is an optimizer barrier. ``partitions``, or the session's
    ``webloom.parse.partitions``, deals the pages out anew first, for an input of fewer splits than cores. ``markdown`` (html, base url, tree -> text) adds a ``markdown`` column from the same parse;
    the base is the ``url`` column, if there is one."""
    from webloom.session import bound_batches, dealt_for_parsing, ship_package
    ship_package(pages.sparkSession)
    bound_batches(pages.sparkSession)
    pages = dealt_for_parsing(pages, partitions)
    keep = [f for f in pages.schema.fields if keep_html or f.name != html_col]
    out_schema = T.StructType(keep + DOM_FIELDS + ([T.StructField("markdown", T.StringType())] if markdown else []))
    keep_names = [f.name for f in keep]

    def parsed(b: pa.RecordBatch) -> pa.RecordBatch:
        htmls = b.column(html_col).to_pylist()
        bases = b.column("url").to_pylist() if "url" in b.schema.names else [None] * len(htmls)
        texts, tpar, nodes, errs, mds = _dom_arrays(htmls, bases, markdown)
        arrays = [b.column(n) for n in keep_names] + [texts, tpar, nodes, errs] + ([mds] if markdown else [])
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out_schema])

    def run(batches):
        for whole in batches:
            for b in _portions(whole, html_col):
                yield parsed(b)  # nothing of a portion is held here while the next one is parsed

    return pages.mapInArrow(run, out_schema)
