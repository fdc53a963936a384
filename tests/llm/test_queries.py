"""Registered queries with SQL against DuckDB; every operator has one query."""

import sys

import duckdb
import pytest

sys.path.insert(0, "scripts")
from check_oracles import digest  # noqa: E402

from webloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_one_query_each():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert sorted(cols) == sorted(df.columns) and len(got) == len(want) and digest(df.columns, got) == digest(cols, want)
