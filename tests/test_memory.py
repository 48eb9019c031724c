"""Whole queries on a small table: their Python runs in the build's parsing only, which holds a bounded part of its input."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import SparkContext
from pyspark.sql import GroupedData

from gramloom.plans import queries as Q
from tests.test_parse import batch_of, peak_mb

NAMES = [
    "lcp_pairs",
    "symbol_kinds",
    "grammar_meta",
    "rule_lengths",
    "simplified_rules",
    "rhs_unrolled",
    "disposable_symbols",
    "id_compaction",
    "ra_samples_strings",
    "rl_rules",
    "decompress",
    "expand_symbol",
    "ra_samples_rules",
    "string_rhs_len",
    "code_sizes",
]
_peaks = {}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(c, t, "user", f"ab{'c' * c} {'la' * t} and some words {c % 3}") for c in range(6) for t in range(3)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))), f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_python_of_a_query_is_bounded(spark, tables, monkeypatch, name):
    frame, ran = type(spark.range(0)), []
    arrow = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: ran.append(f) or arrow(df, f, schema))
    for owner, other in ((frame, "mapInPandas"), (GroupedData, "applyInPandas"), (GroupedData, "applyInArrow"), (SparkContext, "parallelize")):
        monkeypatch.setattr(owner, other, lambda *_, **__: pytest.fail("more Python"))
    Q.QUERIES[name](spark, tables).collect()
    assert {f.__qualname__ for f in ran} == {"build_rows.<locals>.run"}
    key = ran[0].__code__
    if key not in _peaks:
        peak_mb(ran[0], [batch_of(500_000)])  # tables that stay
        _peaks[key] = peak_mb(ran[0], [batch_of(4_000_000)])
    assert _peaks[key] < 40
