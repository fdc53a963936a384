from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from webloom.functions.urls import netloc, normalize_url, resolve_url

BASES = ["https://a.com/b/c/d;p?q#f", "http://a.com", "http://a.com/", "https://x.org:8080/dir/page.html?x=1",
         "http://h.com/a/b/"]
REFS = ["", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "../g", "../..", "../../../g", "./", ".", "..",
        "g/../h", "/./g", "/../g", "g.", ".g", "mailto:x@y", "http://other.com/p", "https:rel", "a//b/../c",
        "?", "#", "  /spaced", "javascript:void(0)"]


@pytest.mark.parametrize("base", BASES)
def test_resolve_matches_urljoin(spark, base):
    df = spark.createDataFrame([(base, r) for r in REFS], "b string, r string")
    got = [x[0] for x in df.select(resolve_url(F.col("b"), F.col("r"))).collect()]
    assert got == [urljoin(base, r) for r in REFS]


def test_netloc_and_normalize(spark):
    df = spark.createDataFrame([("https://User@Host.com:81/x?y",), ("//h/p",), ("rel/path",)], "u string")
    assert [r[0] for r in df.select(netloc("u")).collect()] == ["User@Host.com:81", "h", ""]
    df = spark.createDataFrame([(" HTTP://A.com/X/// ",)], "u string")
    assert df.select(normalize_url("u")).collect()[0][0] == "http://a.com/x"
