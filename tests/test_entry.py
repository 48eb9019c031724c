"""The driver's entry points, and queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gramloom.plans import queries as Q
from gramloom.plans import sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
FAST = ["scan_strings", "collection_stats", "string_offsets", "symbol_runs", "parse_round1", "level_rules", "string_heights", "assign_ids", "grammar_stats", "rl_rewrite", "simplified_stats", "access_range", "parse_coords",
        "merge_marks", "merge_grammars", "access_char", "decompress", "verify_roundtrip", "lcp_pairs", "fp_placement", "incremental_build", "delete_range", "bit_widths", "vbyte_roundtrip", "h0_entropy", "report_space"]


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(sql.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(sql.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, ([r[names.index(c)] for c in df.columns] for r in cur.fetchall())))
    assert sorted(map(repr, map(list, df.collect()))) == want
