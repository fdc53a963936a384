"""Personal data: base kinds against their regular expressions, added kinds, redaction, defined cases."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.llm import pii
from webloom.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        double = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])]
        if 12 <= len(d) <= 19 and sum(double) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.RANK[s[0]]))


def base(spans):
    return [s for s in spans if s[0] in pii.BASE_KINDS]


@pytest.mark.parametrize("alphabet", ["0123456789 -.+()", "1.2@a-b.+", "a@.b-", "0019.25", "+1 ()-.9", "token =:id12 iban ", "http://x@.é1 "])
def test_base_kinds_on_random_texts(alphabet):
    rng, anchors = random.Random(5), pii.automaton()
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert base(pii.find_spans(anchors, text)) == brute(text), text


def test_added_kinds_and_redaction():
    anchors = pii.automaton()
    text = 'Éa http://u.example.org/a?b=1. token = "b7852d4e73166f43" IBAN: DE89 3704 0044 0532 0130 00 x a@b.co, mailto:me@x.org'
    kinds = [(k, text[a:b]) for k, a, b in pii.find_spans(anchors, text)]
    assert ("url", "http://u.example.org/a?b=1") in kinds and ("account", "b7852d4e73166f43") in kinds
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds and ("email", "a@b.co") in kinds
    assert pii.redacted(text, pii.find_spans(anchors, text)) == 'Éa <url>. token = "<account>" IBAN: <account> x <email>, <url>'
    assert pii.find_spans(anchors, "accountant 123456 tokens 99 İİ") == []


def test_time_is_linear_on_hostile_texts():
    anchors = pii.automaton()
    for text in ("token-" * 40_000, "xhttp://" * 40_000, "+1 " * 60_000, "1." * 100_000, "a@" * 100_000, "iban 1 " * 30_000, "1 " * 100_000):
        pii.find_spans(anchors, text)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op3_pii"](spark, sf).collect()}
    import hashlib
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        want, r = brute(text or ""), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
        assert set(filter(None, pii.joined(want).split(","))) <= set(r.spans.split(","))


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "me@x.org", "s"), (2, "me@x.org", "s")], "doc_id long, text string, spans string")
    out = pii.find(df)
    assert out.columns == ["doc_id", "text", "spans"]
    assert sorted(len(r.spans) for r in out.collect()) == [0, 0, 1, 1]
    red = pii.redact(df)
    assert red.columns == df.columns and sorted(str(r.text) for r in red.collect()) == ["", "<email>", "<email>", "None"]
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    assert pii.find(df.select(F.lit("9" * 500_000).alias("text"))).first().spans == []


def test_long_values_are_whole():
    anchors = pii.automaton()
    for key in ("k1" * 40, "a1b2-" * 50_000, "9f" * 100):
        text = f"api_key: {key} end"
        assert ("account", 9, 9 + len(key)) in pii.find_spans(anchors, text)
        assert pii.redacted(text, pii.find_spans(anchors, text)) == "api_key: <account> end"
    inside = "token=" + "-token-1" * 30_000  # cues inside a value; walked once
    assert ("account", 6, len(inside)) in pii.find_spans(anchors, inside)
