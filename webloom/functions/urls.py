"""URL functions (F1-F4, F17, P1-P3) as native Column expressions.

``resolve_url`` follows the RFC 3986 join exactly as Python's ``urllib.parse.urljoin`` does it
(including dot-segment removal) without leaving the JVM: split with one regex, merge paths with
array functions, fold ``.``/``..`` with ``aggregate``.
"""

from __future__ import annotations

from urllib.parse import uses_netloc, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.common import col as _c
from webloom.functions.common import let

# RFC 3986 appendix B split; the scheme rule is the one urlsplit applies (ASCII letter first).
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_NETLOC_SCHEMES = [s for s in uses_netloc if s]
_RELATIVE_SCHEMES = [s for s in uses_relative if s]


def _clean(u: Column) -> Column:
    # urlsplit drops tab/CR/LF anywhere and leading C0 controls or spaces.
    return F.regexp_replace(F.regexp_replace(u, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_parts(u) -> Column:
    """struct(scheme, netloc, path, query, fragment) as ``urlsplit`` gives them ('' when absent)."""
    return let(_clean(_c(u)), lambda v: F.struct(
        F.lower(F.regexp_extract(v, _SPLIT, 1)).alias("scheme"), F.regexp_extract(v, _SPLIT, 2).alias("netloc"),
        F.regexp_extract(v, _SPLIT, 3).alias("path"), F.regexp_extract(v, _SPLIT, 4).alias("query"),
        F.regexp_extract(v, _SPLIT, 5).alias("fragment")))


def netloc(url) -> Column:
    """the authority part (host[:port], userinfo kept), '' when absent."""
    return F.regexp_extract(_clean(_c(url)), _NETLOC, 1)


def site_root(url) -> Column:
    """scheme://netloc."""
    return F.regexp_extract(_c(url), r"^([^:/?#]+://[^/?#]*)", 1)


def _unsplit(scheme: Column, net: Column, path: Column, query: Column, frag: Column) -> Column:
    in_netloc = scheme.isin(*_NETLOC_SCHEMES)
    p = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when((net != "") | (in_netloc & ~path.startswith("//")),
                  F.concat(F.lit("//"), net, p)).otherwise(path)
    out = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(frag != "", F.concat(out, F.lit("#"), frag)).otherwise(out)


def _merge_path(bpath: Column, path: Column) -> Column:
    def with_rel(rel):
        n = F.size(rel)
        return F.when(n <= 2, rel).otherwise(F.concat(
            F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, n - 2), lambda s: s != ""), F.slice(rel, -1, 1)))

    def fold(segs):
        folded = F.aggregate(
            segs, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        folded = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))) \
            .otherwise(folded)
        return let(F.array_join(folded, "/"), lambda j: F.when(j == "", F.lit("/")).otherwise(j))

    base_parts = let(F.split(bpath, "/", -1), lambda bp: F.when(
        F.element_at(bp, -1) != "", F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp))
    rel = let(F.concat(base_parts, F.split(path, "/", -1)), with_rel)
    segs = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(rel)
    return let(segs, fold)


def resolve_url(base, href) -> Column:
    """``urljoin(base, href)``."""
    base, href = _c(base), _c(href)

    def body(r):
        b, h = r["b"], r["h"]
        scheme = F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"])
        return let(F.struct(scheme.alias("s")), lambda sc: _join(sc["s"], b, h, r["href"]))

    def _join(scheme, b, h, raw):
        relative_ok = scheme.isin(*_RELATIVE_SCHEMES) & (scheme == b["scheme"])
        in_netloc = scheme.isin(*_NETLOC_SCHEMES)
        net = F.when(in_netloc, b["netloc"]).otherwise(h["netloc"])
        same_doc = _unsplit(scheme, net, b["path"], F.when(h["query"] == "", b["query"]).otherwise(h["query"]),
                            h["fragment"])
        merged = let(_merge_path(b["path"], h["path"]),
                     lambda p: _unsplit(scheme, net, p, h["query"], h["fragment"]))
        return (F.when(~relative_ok, raw)
                .when(in_netloc & (h["netloc"] != ""), _unsplit(scheme, h["netloc"], h["path"], h["query"], h["fragment"]))
                .when(h["path"] == "", same_doc)
                .otherwise(merged))

    joined = let(F.struct(url_parts(base).alias("b"), url_parts(href).alias("h"), href.alias("href")), body)
    return (F.when(base.isNull() | (base == ""), href)
            .when(href.isNull() | (href == ""), base)
            .otherwise(joined))


def normalize_url(url) -> Column:
    """lower-cased, whitespace-trimmed, every trailing '/' removed."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(url), r"(?U)^\s+|\s+$", "")), "/+$", "")


def link_ok(href) -> Column:
    """Not an in-page anchor, script, mail or phone link (case-sensitive prefixes)."""
    return ~_c(href).rlike(r"^(#|javascript:|mailto:|tel:)")


def same_netloc(url, base) -> Column:
    """Netloc equality, port and case included."""
    return netloc(url) == netloc(base)


def is_external(url, base) -> Column:
    """True when no base is given, else netloc differs."""
    base = _c(base)
    return F.when(base.isNull() | (netloc(base) == ""), F.lit(True)).otherwise(netloc(url) != netloc(base))


def wiki_url(title) -> Column:
    """article URL from a title."""
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(_c(title), F.lit(" "), F.lit("_")))
