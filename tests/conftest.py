import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from webloom.session import get_spark
    s = get_spark("local[4]", app="webloom-tests", shuffle_partitions=8)
    yield s


@pytest.fixture
def parse(spark):
    from webloom.operators.dom import parse_pages

    def run(html, url="https://test.com/page", keep_html=False):
        df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        return parse_pages(df, keep_html=keep_html)
    return run
