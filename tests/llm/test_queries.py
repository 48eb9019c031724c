"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gramloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, ([r[names.index(c)] for c in df.columns] for r in cur.fetchall())))
    assert sorted(map(repr, map(list, df.collect()))) == want


def test_one_query_for_each():
    assert [sum(q.startswith(f"op{n}_") for q in Q.QUERIES) for n in range(1, 11)] == [1] * 10
