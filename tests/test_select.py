"""Selectors against a plain walk of the same tree, and their cost on long lists of siblings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from webloom.operators import extract as X
from webloom.operators.dom import parse_pages


def _nodes(parsed):
    return parsed.select("nodes").first().nodes


def _up(nodes, n):
    while n.parent is not None:
        n = nodes[n.parent]
        yield n


def _earlier(nodes, n):
    return [m for m in nodes if m.parent == n.parent and m.id < n.id]


def _page(seed):
    rng = random.Random(seed)

    def some(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag, cls = rng.choice("abi"), rng.choice(["", " class=x", " class='x y'", " id=k"])
            out += f"<{tag}{cls}>t{rng.randint(0, 99)}{some(depth - 1) if depth and rng.random() < .7 else ''}</{tag}>"
        return out
    return f"<div>{some(4)}</div><div>{some(3)}</div>"


def _cls(n, c):
    return c in (n.attrs.get("class") or "").split()


CSS = {
    "a b": lambda ns, n: n.tag == "b" and any(u.tag == "a" for u in _up(ns, n)),
    "a > b.x": lambda ns, n: n.tag == "b" and _cls(n, "x") and n.parent is not None and ns[n.parent].tag == "a",
    "a + i": lambda ns, n: n.tag == "i" and n.prev is not None and ns[n.prev].tag == "a",
    "b.x ~ i": lambda ns, n: n.tag == "i" and any(m.tag == "b" and _cls(m, "x") for m in _earlier(ns, n)),
    "a ~ b i": lambda ns, n: n.tag == "i" and any(u.tag == "b" and any(m.tag == "a" for m in _earlier(ns, u)) for u in _up(ns, n)),
    "i:nth-of-type(2)": lambda ns, n: n.tag == "i" and sum(m.tag == "i" for m in _earlier(ns, n)) == 1,
    ":nth-of-type(odd)": lambda ns, n: sum(m.tag == n.tag for m in _earlier(ns, n)) % 2 == 0,
    "b:not(a ~ b), i.y": lambda ns, n: (n.tag == "b" and not any(m.tag == "a" for m in _earlier(ns, n))) or (n.tag == "i" and _cls(n, "y")),
}

XPATHS = {
    "//a[2]": lambda ns, n: n.tag == "a" and sum(m.tag == "a" for m in _earlier(ns, n)) == 1,
    "//b[@class='x'][2]": lambda ns, n: n.tag == "b" and n.attrs.get("class") == "x"
    and sum(m.tag == "b" and m.attrs.get("class") == "x" for m in _earlier(ns, n)) == 1,
    "//a/b[1]": lambda ns, n: n.tag == "b" and n.parent is not None and ns[n.parent].tag == "a" and not any(m.tag == "b" for m in _earlier(ns, n)),
    "//a//i[@id]": lambda ns, n: n.tag == "i" and "id" in n.attrs and any(u.tag == "a" for u in _up(ns, n)),
    "/div/*[3]": lambda ns, n: n.parent is not None and ns[n.parent].parent is None and ns[n.parent].tag == "div" and len(_earlier(ns, n)) == 2,
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://t.test/{k}", _page(k)) for k in range(12)]
    return parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).persist()


def test_base_selectors_equal_a_plain_walk(pages):
    trees = {r.page_id: r.nodes for r in pages.select("page_id", "nodes").collect()}
    for how, table in (("css", CSS), ("xpath", XPATHS)):
        for selector, passes in table.items():
            took = X.extract_css(pages, selector, {"v": "@"}) if how == "css" else X.extract_xpath(pages, selector, {"v": "."})
            got = {k: [] for k in trees}
            for r in took.orderBy("page_id", "pos").collect():
                got[r.page_id].append(r.v)
            own = {r.page_id: r.v for r in pages.select("page_id", F.transform("nodes", lambda n: X.text_of(n) if how == "css" else X.raw_text_of(n)).alias("v")).collect()}
            want = {k: [own[k][n.id] for n in ns if passes(ns, n)] for k, ns in trees.items()}
            assert got == want, selector


def test_first_hits_inside_nested_bases(pages):
    """Bases lie inside each other; a field is the first hit below its own base."""
    trees = {r.page_id: r.nodes for r in pages.select("page_id", "nodes").collect()}
    raw = {r.page_id: r.v for r in pages.select("page_id", F.transform("nodes", lambda n: X.raw_text_of(n)).alias("v")).collect()}
    got = X.extract_xpath(pages, "//a", {"any": ".//b", "child": "./i", "deep": "./b//i", "grand": ".//b/a[2]", "page": "//i"}).orderBy("page_id", "pos").collect()
    want = []
    for k, ns in sorted(trees.items()):
        below = lambda b, n: b.id < n.id <= b.last
        for b in [n for n in ns if n.tag == "a"]:
            def one(test):
                return next((raw[k][n.id] for n in ns if test(n)), None)
            want.append((k, one(lambda n: below(b, n) and n.tag == "b"), one(lambda n: n.tag == "i" and n.parent == b.id),
                         one(lambda n: n.tag == "i" and any(u.tag == "b" and u.parent == b.id for u in _up(ns, n))),
                         one(lambda n: n.tag == "a" and below(b, n) and below(b, ns[n.parent]) and ns[n.parent].tag == "b"
                             and sum(m.tag == "a" for m in _earlier(ns, n)) == 1),
                         one(lambda n: n.tag == "i")))
    assert [(r.page_id, r.any, r.child, r.deep, r.grand, r.page) for r in got] == want
    css = X.extract_css(pages, "a", {"f": "b.x"}).orderBy("page_id", "pos").collect()
    text = {r.page_id: r.v for r in pages.select("page_id", F.transform("nodes", lambda n: X.text_of(n)).alias("v")).collect()}
    assert [r.f for r in css] == [next((text[k][n.id] for n in ns if b.id < n.id <= b.last and n.tag == "b" and _cls(n, "x")), None)
                                  for k, ns in sorted(trees.items()) for b in ns if b.tag == "a"]


def test_long_sibling_lists_are_linear(parse):
    took = []
    for n in (2_500, 20_000):
        page = parse("<ul>" + "".join(f"<li class={'odd' if k % 2 else 'even'}><b>{k}</b></li>" for k in range(n)) + "</ul>").persist()
        page.count()
        began = time.time()
        assert [r.v for r in X.extract_xpath(page, "//li[@class='odd'][1000]", {"v": "./b"}).collect()] == ["1999"]
        assert X.extract_css(page, "li.odd ~ li.even", {"v": "b"}).count() == n // 2 - 1
        assert X.extract_css(page, "li:nth-of-type(even)", {"v": "b"}).count() == n // 2
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] + 2


def test_empty_pages_and_missing_parts(parse):
    for html in ("", "text only", "<p></p>"):
        page = parse(html)
        assert X.extract_css(page, "a ~ b", {"v": "i"}).count() == 0 and X.extract_xpath(page, "//a[2]", {"v": "./b"}).count() == 0
    r = X.extract_xpath(parse("<a></a>"), "//a", {"v": {"xpath": "./b/@id", "default": "none"}, "w": ".//c"}).first()
    assert (r.v, r.w) == ("none", None)


def test_two_indexes_in_one_selector_stay_apart(parse):
    """Conditions that differ in nothing but the index they ask."""
    page = parse("<p>0</p><b>1</b><i>2</i><u>3</u><s><b>4</b></s><q><i>5</i></q>")
    found = lambda sel: [r.v for r in X.extract_css(page, sel, {"v": "@"}).collect()]
    assert found("u ~ s, i ~ u, p ~ b") == ["1", "3", "4"] and found("u ~ s b, q ~ i i, u ~ q i") == ["4", "5"]
    assert [r.v for r in X.extract_xpath(page, "//b[1][2]", {"v": "."}).collect()] == []
