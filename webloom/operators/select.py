"""CSS selectors and an XPath subset, compiled on the driver into Column predicates over the DOM arrays.

A compiled selector (``Selector``) has predicates over ``node``, a struct Column of the node type (see ``dom``), and
``tree``, the page's node array with the sibling indexes that the selector asks for; ``bind`` makes the tree once a page.
Parents are O(1) ``F.get(nodes, i)`` lookups, ancestor tests walk the parent pointers with ``aggregate`` (O(depth)). What
asks about earlier siblings (``~``, positions) is a count in a sorted index of (parent, node) keys, found by binary
search, so a long list of siblings is not walked for each of them. Node ids are in document order and an element's
descendants are the ids up to its ``last``: what is inside an element is a range of a sorted list of hits (``lower_bound``).
Unsupported syntax raises ``ValueError`` here, at plan time, never inside a task.

CSS: type, ``*``, ``.c``, ``#i``, ``[a]``, ``[a=v]``, ``~= ^= $= *= |=``, descendant, ``>``, ``+``, ``~``,
comma lists, ``:first-child :last-child :only-child :nth-child(an+b|odd|even) :nth-of-type(k) :not(...)``.
XPath: absolute/relative location paths with ``/`` and ``//`` steps, ``*``, name tests, predicates
``[k]``, ``[@a]``, ``[@a='v']``, ``[contains(@a,'v')]``, ``[starts-with(@a,'v')]``, ``and``;
several in a row, each position among the siblings that pass what stands before it;
terminal ``/@a`` and ``/text()``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.common import let


def _attr(node: Column, name: str) -> Column:
    return node["attrs"].getItem(name)


def any_ancestor(node: Column, tree: "Tree", test) -> Column:
    """True when some proper ancestor of ``node`` satisfies ``test(ancestor)``."""
    init = F.struct(node["parent"].alias("cur"), F.lit(False).alias("hit"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(node["depth"], F.lit(1))), init,
        lambda acc, _i: let(F.get(tree.nodes, acc["cur"]), lambda up: F.struct(
            up["parent"].alias("cur"), (acc["hit"] | F.coalesce(test(up), F.lit(False))).alias("hit"))))
    return walk["hit"]


def parent_is(node: Column, tree: "Tree", test) -> Column:
    return node["parent"].isNotNull() & F.coalesce(let(F.get(tree.nodes, node["parent"]), test), F.lit(False))


def lower_bound(ascending: Column, value: Column) -> Column:
    """How many elements of a sorted array are below ``value``: a binary search of ``log2(size)`` steps."""
    def half(acc, _i):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.get(ascending, mid) < value
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ascending)))), start, half, lambda acc: acc["lo"])


def _place(node: Column, low: Column | None = None) -> Column:
    """Sort key of a node among all: its parent, then itself; with ``low`` the key before all of that parent's children."""
    return F.shiftleft(F.coalesce(node["parent"], F.lit(-1)).cast("long") + 1, 32) + (node["id"].cast("long") if low is None else low)


@dataclass(frozen=True, eq=False)
class Siblings:
    """How many earlier siblings of a node pass ``test`` (those of its own tag only, with ``same_tag``)."""
    test: object
    same_tag: bool = False

    def keys(self, tree: "Tree") -> Column:
        own = F.filter(tree.nodes, lambda n: F.coalesce(self.test(n, tree), F.lit(False)))
        return F.sort_array(F.transform(own, lambda n: self._key(n)))

    def before(self, node: Column, tree: "Tree") -> Column:
        keys = tree.keys[self]
        return lower_bound(keys, self._key(node)) - lower_bound(keys, self._key(node, F.lit(0).cast("long")))

    def _key(self, node: Column, low: Column | None = None) -> Column:
        return F.struct(node["tag"].alias("tag"), _place(node, low).alias("at")) if self.same_tag else _place(node, low)


@dataclass
class Tree:
    """A page's nodes and the sorted keys of the sibling indexes."""
    nodes: Column
    keys: dict


def bind(siblings: list, nodes: Column, body) -> Column:
    """``body(tree)`` with every index computed once; one may use those before it. All are fields of one bound struct: Catalyst
    takes two lambdas for equal that differ in nothing but the outer variables they use, and would drop one of them."""
    def step(k: int, tree: Tree) -> Column:
        if k == len(siblings):
            return body(tree)
        known = [tree.keys[s].alias(f"k{j}") for j, s in enumerate(siblings[:k])]
        return let(F.struct(*known, siblings[k].keys(tree).alias(f"k{k}")),
                   lambda all_keys: step(k + 1, Tree(nodes, {s: all_keys[f"k{j}"] for j, s in enumerate(siblings[:k + 1])})))
    return step(0, Tree(nodes, {}))


# ----------------------------------------------------------------------------- CSS

_IDENT = r"-?[_a-zA-Z\u00a0-\uffff][_a-zA-Z0-9\-\u00a0-\uffff]*"
_TOKEN = re.compile(
    r"\s*(?P<comb>[>+~,])\s*|(?P<ws>\s+)|(?P<type>\*|" + _IDENT + r")"
    r"|#(?P<id>" + _IDENT + r")|\.(?P<cls>" + _IDENT + r")"
    r"|\[\s*(?P<aname>[^\s~|^$*=\]]+)\s*(?:(?P<aop>[~|^$*]?=)\s*(?P<aval>\"[^\"]*\"|'[^']*'|[^\]\s]+))?\s*\]"
    r"|:(?P<pseudo>[a-zA-Z-]+)(?:\((?P<parg>[^()]*(?:\([^()]*\)[^()]*)*)\))?")


@dataclass
class Compound:
    tag: str | None = None
    tests: list = field(default_factory=list)   # functions (node, tree) -> Column

    def pred(self, node: Column, tree: Tree) -> Column:
        c = F.lit(True) if self.tag in (None, "*") else (node["tag"] == self.tag)
        for t in self.tests:
            c = c & t(node, tree)
        return c


@dataclass
class Selector:
    """``pred(node, tree)`` for CSS and for paths from the document. A relative path is ``own(node, tree)``, the tests of its last step,
    and ``chain(node, tree, ctx)``, how the node hangs below the context node; ``inside`` says that it is a descendant
    at any depth, so that its first hit is the first of its range; ``document``, that a path starts at the document and has one
    first hit for all bases. ``siblings`` are the indexes ``bind`` makes for it."""
    siblings: list
    pred: object = None
    own: object = None
    chain: object = None
    inside: bool = False
    document: bool = False
    terminal: tuple | None = None


def _attr_test(name: str, op: str | None, val: str | None):
    name = name.lower()
    if val is not None and len(val) >= 2 and val[0] == val[-1] and val[0] in "'\"":
        val = val[1:-1]

    def test(node, tree):
        a = _attr(node, name)
        if op is None:
            return a.isNotNull()
        if op == "=":
            return a == val
        if op == "~=":
            return F.array_contains(F.split(F.trim(a), r"\s+"), val) if val and " " not in val else F.lit(False)
        if op == "^=":
            return a.startswith(val) if val else F.lit(False)
        if op == "$=":
            return a.endswith(val) if val else F.lit(False)
        if op == "*=":
            return a.contains(val) if val else F.lit(False)
        if op == "|=":
            return (a == val) | a.startswith(val + "-")
        raise ValueError(f"unsupported attribute operator {op}")
    return test


def _nth(arg: str):
    a = arg.replace(" ", "").lower()
    if a == "odd":
        return 2, 1
    if a == "even":
        return 2, 0
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", a)
    if m:
        k = m.group(1)
        step = 1 if k in ("", "+") else -1 if k == "-" else int(k)
        return step, int(m.group(2) or 0)
    if re.fullmatch(r"[+-]?\d+", a):
        return 0, int(a)
    raise ValueError(f"unsupported :nth-child argument {arg!r}")


def _nth_test(pos_fn, arg):
    step, off = _nth(arg)

    def test(node, tree):
        p = pos_fn(node, tree)
        if step == 0:
            return p == off
        d = p - off
        return ((d % step) == 0) & ((d / step) >= 0)
    return test


def _pseudo_test(name: str, arg: str | None, siblings: list):
    name = name.lower()
    if name == "first-child":
        return lambda n, ns: n["prev"].isNull()
    if name == "last-child":
        return lambda n, ns: n["next"].isNull()
    if name == "only-child":
        return lambda n, ns: n["prev"].isNull() & n["next"].isNull()
    if name == "nth-child" and arg:
        return _nth_test(lambda n, ns: n["idx"], arg)
    if name == "nth-of-type" and arg:
        alike = Siblings(lambda n, t: F.lit(True), same_tag=True)
        siblings.append(alike)
        return _nth_test(lambda n, t: alike.before(n, t) + 1, arg)
    if name == "not" and arg:
        inner = _css_pred(arg, siblings)
        return lambda n, t: ~F.coalesce(inner(n, t), F.lit(False))
    raise ValueError(f"unsupported pseudo-class :{name}")


def _parse_css(sel: str, siblings: list):
    """-> list of complex selectors; each is [(combinator, Compound)], first combinator None."""
    out, cur, comp, comb = [], [], None, None
    pos, s = 0, sel.strip()
    if not s:
        raise ValueError("empty selector")
    while pos < len(s):
        m = _TOKEN.match(s, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported CSS selector syntax at {s[pos:]!r}")
        pos = m.end()
        g = m.lastgroup if m.lastgroup not in ("aop", "aval", "parg") else None
        if m.group("comb"):
            c = m.group("comb")
            if comp is not None:
                cur.append((comb, comp))
                comp = None
            if c == ",":
                if not cur:
                    raise ValueError(f"bad selector list {sel!r}")
                out.append(cur)
                cur, comb = [], None
            else:
                comb = c
            continue
        if m.group("ws") is not None:
            if comp is not None:
                cur.append((comb, comp))
                comp, comb = None, " "
            continue
        if comp is None:
            comp = Compound()
        if m.group("type"):
            if comp.tag is not None or comp.tests:
                raise ValueError(f"type selector must come first in {sel!r}")
            comp.tag = m.group("type").lower()
        elif m.group("id"):
            v = m.group("id")
            comp.tests.append(lambda n, ns, v=v: _attr(n, "id") == v)
        elif m.group("cls"):
            v = m.group("cls")
            comp.tests.append(lambda n, ns, v=v: F.coalesce(
                F.array_contains(F.split(F.trim(_attr(n, "class")), r"\s+"), v), F.lit(False)))
        elif m.group("aname"):
            comp.tests.append(_attr_test(m.group("aname"), m.group("aop"), m.group("aval")))
        elif m.group("pseudo"):
            comp.tests.append(_pseudo_test(m.group("pseudo"), m.group("parg"), siblings))
    if comp is not None:
        cur.append((comb, comp))
    elif comb not in (None, " "):
        raise ValueError(f"dangling combinator in {sel!r}")
    if not cur:
        raise ValueError(f"bad selector {sel!r}")
    out.append(cur)
    return out


def _joined(left, comb: str, comp: Compound, siblings: list):
    """The predicate of a compound that follows what ``left`` selects."""
    if comb == " ":
        return lambda n, t: comp.pred(n, t) & any_ancestor(n, t, lambda a: left(a, t))
    if comb == ">":
        return lambda n, t: comp.pred(n, t) & parent_is(n, t, lambda a: left(a, t))
    if comb == "+":
        return lambda n, t: comp.pred(n, t) & n["prev"].isNotNull() & F.coalesce(let(F.get(t.nodes, n["prev"]), lambda a: left(a, t)), F.lit(False))
    if comb == "~":
        earlier = Siblings(left)
        siblings.append(earlier)
        return lambda n, t: comp.pred(n, t) & (earlier.before(n, t) > 0)
    raise ValueError(f"unsupported combinator {comb!r}")


def _css_pred(selector: str, siblings: list):
    preds = []
    for (_, first), *rest in _parse_css(selector, siblings):
        pred = first.pred
        for comb, comp in rest:
            pred = _joined(pred, comb, comp, siblings)
        preds.append(pred)

    def either(node, tree):
        c = preds[0](node, tree)
        for p in preds[1:]:
            c = F.coalesce(c, F.lit(False)) | p(node, tree)
        return c
    return either


def compile_css(selector: str) -> Selector:
    siblings: list = []
    return Selector(siblings, pred=_css_pred(selector, siblings))


# ----------------------------------------------------------------------------- XPath

@dataclass
class XPath:
    absolute: bool                 # starts at the document, else at the context node
    steps: list                    # [(axis, [Compound or position, ...])], axis in {"child", "desc"}
    terminal: tuple | None = None  # ("attr", name) | ("text",) | None for elements


_STEP = re.compile(r"(?P<name>\*|[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)(?P<preds>(?:\[[^\]]*\])*)$")
_PRED = re.compile(r"\[([^\]]*)\]")
_QUOTED = r"(?:'([^']*)'|\"([^\"]*)\")"


def _xpred(expr: str, comp: Compound):
    expr = expr.strip()
    parts = re.split(r"\s+and\s+", expr)
    if len(parts) > 1:
        for p in parts:
            pos = _xpred(p, comp)
            if pos is not None:
                raise ValueError("position inside 'and' is not supported")
        return None
    if re.fullmatch(r"\d+", expr):
        return int(expr)
    m = re.fullmatch(r"@([\w:.\-]+)", expr)
    if m:
        comp.tests.append(_attr_test(m.group(1), None, None))
        return None
    m = re.fullmatch(r"@([\w:.\-]+)\s*=\s*" + _QUOTED, expr)
    if m:
        comp.tests.append(_attr_test(m.group(1), "=", m.group(2) if m.group(2) is not None else m.group(3)))
        return None
    m = re.fullmatch(r"(contains|starts-with)\(\s*@([\w:.\-]+)\s*,\s*" + _QUOTED + r"\s*\)", expr)
    if m:
        val = m.group(3) if m.group(3) is not None else m.group(4)
        name = m.group(2).lower()
        if m.group(1) == "contains":
            comp.tests.append(lambda n, ns: F.coalesce(_attr(n, name).contains(val), F.lit(False)))
        else:
            comp.tests.append(lambda n, ns: F.coalesce(_attr(n, name).startswith(val), F.lit(False)))
        return None
    raise ValueError(f"unsupported XPath predicate [{expr}]")


def parse_xpath(path: str) -> XPath:
    p = path.strip()
    if p in (".", "./"):
        return XPath(False, [])
    absolute = p.startswith("/")
    if p.startswith("./") or p.startswith(".//"):
        p = p[1:]
    elif not absolute:
        p = "/" + p          # a bare relative path starts with a child step
    terminal = None
    m = re.search(r"/@([\w:.\-]+)$", p)
    if m:
        terminal, p = ("attr", m.group(1).lower()), p[:m.start()]
    elif p.endswith("/text()"):
        terminal, p = ("text",), p[: -len("/text()")]
    steps = []
    if not p:
        return XPath(absolute, steps, terminal)
    tokens = re.split(r"(//|/)", p)[1:]
    axis = "child"
    for tok in tokens:
        if tok == "/":
            axis = "child"
            continue
        if tok == "//":
            axis = "desc"
            continue
        m = _STEP.match(tok)
        if not m:
            raise ValueError(f"unsupported XPath step {tok!r} in {path!r}")
        tests = [Compound(tag=m.group("name").lower())]
        for pe in _PRED.findall(m.group("preds")):
            comp = tests[-1] if isinstance(tests[-1], Compound) else Compound(tag="*")
            pos = _xpred(pe, comp)
            if pos is not None:
                tests.append(pos)
            elif comp is not tests[-1]:
                tests.append(comp)
        steps.append((axis, tests))
    return XPath(absolute, steps, terminal)


def _passes(tests: list, siblings: list):
    """All of a step's tests; a number is the position among the siblings that pass the tests before it."""
    *before, last = tests
    if not before:
        return last.pred
    left = _passes(before, siblings)
    if isinstance(last, Compound):
        return lambda n, t: left(n, t) & last.pred(n, t)
    if len(before) == 1 and before[0].tag == "*" and not before[0].tests:
        return lambda n, t: n["idx"] == last
    earlier = Siblings(left)
    siblings.append(earlier)
    return lambda n, t: left(n, t) & (earlier.before(n, t) == last - 1)


def _linked(steps: list, passes: list, k: int, absolute: bool):
    """``chain(node, tree, ctx)``: how a node that passes step ``k`` hangs below the steps before it."""
    if k == 0:
        if absolute:
            return lambda n, t, ctx: n["parent"].isNull() if steps[0][0] == "child" else F.lit(True)
        if steps[0][0] == "child":
            return lambda n, t, ctx: n["parent"] == ctx["id"]
        return lambda n, t, ctx: (n["id"] > ctx["id"]) & (n["id"] <= ctx["last"])
    up = _linked(steps, passes, k - 1, absolute)
    rise = parent_is if steps[k][0] == "child" else any_ancestor
    return lambda n, t, ctx: rise(n, t, lambda a: passes[k - 1](a, t) & up(a, t, ctx))


def compile_xpath(path: str, document: bool = False) -> Selector:
    """A path; neither ``pred`` nor ``own`` is set for '.' (the context node itself). With ``document`` a relative path
    starts at the document, as the path of base nodes does."""
    xp = parse_xpath(path)
    siblings: list = []
    if not xp.steps:
        return Selector(siblings, terminal=xp.terminal)
    passes = [_passes(tests, siblings) for _, tests in xp.steps]
    own, absolute = passes[-1], xp.absolute or document
    chain = _linked(xp.steps, passes, len(xp.steps) - 1, absolute)
    if absolute:
        return Selector(siblings, pred=lambda n, t: own(n, t) & chain(n, t, None), document=True, terminal=xp.terminal)
    return Selector(siblings, own=own, chain=chain, inside=len(xp.steps) == 1 and xp.steps[0][0] == "desc", terminal=xp.terminal)
