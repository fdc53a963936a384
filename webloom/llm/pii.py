"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds anchors: at-signs, plus signs before a digit, digits,
URL schemes and identifier cues. From each anchor a deterministic parser walks to the left and right over the
characters its kind allows, and validates what it has found. Every position is a code point, ends are exclusive.

Base kinds (leftmost non-overlapping matches of a kind's pattern, those that fail validation dropped):
``email``, ``ip`` (four numbers up to 255), ``card`` (12 to 19 digits, Luhn), ``phone`` (+, 9 to 15 digits).
Added kinds: ``url`` (a scheme and an address without spaces) and ``account`` (the value after an identifier cue such
as ``iban`` or ``token =``: 6 to 64 letters, digits, dashes or spaced groups of four, with a digit)."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import map_values

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "account")

#: Schemes of addresses, and the words that announce an account or identifier.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "api_key", "apikey", "password", "customer id", "user id",
        "tax id", "licence no", "license no")

DIGITS = frozenset(string.digits)
LETTERS = frozenset(string.ascii_letters)
WORD = LETTERS | DIGITS
LOCAL = WORD | frozenset("._%+-")
LABEL = WORD | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL = WORD | frozenset("-._~:/?#[]@!$&'()*+,;=%")
VALUE = WORD | frozenset("-_")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in string.digits:
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    a.add_word("@", ("at", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def run_end(text: str, at: int, allowed: frozenset, most: int | None = None) -> int:
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Bounds of the address around the at-sign, whose local part may not begin before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (label := run_end(text, end + 1, LABEL)) > end + 1:
        end, dots = label, dots + 1
    return (start, end) if dots else None


def ip_from(text: str, start: int) -> tuple[int, bool] | None:
    """End of four numbers joined by dots from the digit at ``start``, and whether each is at most 255."""
    end, valid = start, True
    for part in range(4):
        if part:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        stop = run_end(text, end, DIGITS)
        if stop == end:
            return None
        valid &= len(text[end:stop].lstrip("0")) <= 3 and int(text[end:stop].lstrip("0") or "0") <= 255
        end = stop
    return end, valid


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_from(text: str, start: int) -> int:
    """End of the digits from ``start``, each after at most one space or dash."""
    end, n = start + 1, len(text)
    while True:
        if end < n and text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            return end


def phone_from(text: str, plus: int) -> int | None:
    """End of the phone number that begins with ``+`` and a digit at ``plus``."""
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 else None


def url_from(text: str, start: int, after: int) -> tuple[int, int] | None:
    if start and text[start - 1] in WORD:
        return None
    end = run_end(text, after, URL)
    while end > after and text[end - 1] in ".,;:!?'()[]*$&%":
        end -= 1
    return (start, end) if end > after else None


def account_from(text: str, start: int, after: int, known: list[int]) -> tuple[int, int] | None:
    """The value that follows a cue, whole at any length: optional words ``number``/``no``/``id``, a ``:`` , ``=`` or ``#`` or
    spaces, quotes. ``known``: the run of value characters walked last, and its last digit."""
    if start and text[start - 1] in WORD:
        return None
    at, lower = after, text[after:after + 24].lower()
    for word in (" number", " no.", " no", " id"):
        if lower.startswith(word):
            at += len(word)
            break
    if at < len(text) and text[at] in WORD:
        return None
    at = run_end(text, at, frozenset(" :=#\"'"))
    if not known[0] <= at < known[1]:  # cues inside a long run don't walk it again
        stop = run_end(text, at, VALUE)
        known[:] = at, stop, next((i for i in range(stop - 1, at - 1, -1) if text[i] in DIGITS), -1)
    _, end, digit = known
    if end - at <= 4:  # groups of up to four, as account numbers are printed
        while text[end:end + 1] == " " and 0 < (stop := run_end(text, end + 1, VALUE, 5)) - end - 1 <= 4 \
                and any(c in DIGITS for c in text[end + 1:stop]):
            end = digit = stop
    return (at, end) if end - at >= 6 and digit >= at else None


#: Ranks of kinds among spans that begin at one place.
RANK = {k: i for i, k in enumerate(KINDS)}


def lowered(text: str) -> str:
    """Lower case for the cues, with every position as it was (a few capitals have a longer lower case)."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find_spans(anchors: ahocorasick.Automaton, text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start, then kind as listed in KINDS."""
    spans, known = [], [0, 0, -1]
    done = dict.fromkeys(("email", "ip", "card", "phone", "url"), 0)  # where the next match of a kind may begin
    for last, (what, size) in anchors.iter(lowered(text)):
        at = last - size + 1
        if what == "digit":
            if at >= done["card"]:
                end = digits_from(text, at)
                if end > at + 1:
                    done["card"] = end
                    number = text[at:end].replace(" ", "").replace("-", "")
                    if 12 <= len(number) <= 19 and luhn(number):
                        spans.append(("card", at, end))
            if at >= done["ip"]:
                if found := ip_from(text, at):
                    done["ip"] = found[0]
                    if found[1]:
                        spans.append(("ip", at, found[0]))
                else:  # no later digit of this number can begin a match either
                    done["ip"] = run_end(text, at, DIGITS)
        elif what == "at":
            if at >= done["email"] and (found := email_at(text, at, done["email"])):
                done["email"] = found[1]
                spans.append(("email", *found))
        elif what == "plus":
            if at >= done["phone"] and (end := phone_from(text, at)):
                done["phone"] = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    spans.append(("phone", at, end))
        elif what == "scheme":
            if at >= done["url"] and (found := url_from(text, at, last + 1)):
                done["url"] = found[1]
                spans.append(("url", *found))
        elif found := account_from(text, at, last + 1, known):
            spans.append(("account", *found))
    return sorted(set(spans), key=lambda s: (s[1], RANK[s[0]], s[2]))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each group of overlapping spans replaced by ``<kind>`` of its first and longest span."""
    out, at = [], 0
    groups: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if groups and a < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], b)
        else:
            groups.append([kind, a, b])
    for kind, a, b in groups:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType())])


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``spans array<struct<kind,start,end>>`` to every row of ``df``. A null or empty text has none; whole
    texts are read; an added column replaces one of its name; other columns (or those in ``keep``) stay."""
    out = T.StructType([T.StructField("spans", T.ArrayType(_SPAN))])

    def start():
        anchors = automaton()
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(anchors, t or "")] for t in texts]]
    return map_values(df, F.col(f"`{text}`"), out, start, df.columns if keep is None else keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by ``<kind>``; a null text stays null; all columns stay."""
    out = T.StructType([T.StructField(text, T.StringType())])

    def start():
        anchors = automaton()
        return lambda texts: [[t if t is None else redacted(t, find_spans(anchors, t)) for t in texts]]
    return map_values(df, F.col(f"`{text}`"), out, start, df.columns).select(*[f"`{c}`" for c in df.columns])


def digests(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds counts by base kind, ``base_sha256`` of the base spans and ``spans``, all spans as a string. A null or empty
    text has none, texts are read whole, repeated rows stay, an empty table gives no rows; an added column replaces one of its
    name, other columns (or those in ``keep``) stay."""
    out = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
                        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def start():
        anchors = automaton()

        def work(texts):
            made = []
            for t in texts:
                spans = find_spans(anchors, t or "")
                base = [s for s in spans if s[0] in BASE_KINDS]
                made.append([sum(s[0] == k for s in base) for k in BASE_KINDS]
                            + [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
            return [list(c) for c in zip(*made, strict=True)] if made else [[] for _ in out]
        return work
    return map_values(df, F.col(f"`{text}`"), out, start, df.columns if keep is None else keep)
