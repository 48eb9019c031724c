"""Scalar functions against plain Python."""

import math

from pyspark.sql import functions as F

from gramloom.functions import metrics as M
from gramloom.plans.materialize import with_row_index, with_running_sum

VALUES = [0, 1, 2, 3, 4, 127, 128, 129, 255, 256, 16383, 16384, 2**31, 2**40 + 5]


def vbyte(v):
    out = []
    while True:
        out.append(v & 127)
        v >>= 7
        if not v:
            return out


def test_widths(spark):
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in VALUES], "v long").select("v", M.bit_width(v), M.next_power_of_two(v), M.prev_power_of_two(v), M.is_power_of_two(v), M.round_to_power_of_two(v), M.vbyte_len(v))
    for x, width, up, down, power, rounded, size in df.collect():
        n = x.bit_length()
        assert (width, up, down) == (n, 1 << n, (1 << n - 1) if x else None)
        assert power == (x & (x - 1) == 0) and rounded == (x if x & (x - 1) == 0 else 1 << n) and size == len(vbyte(x))


def test_vbyte(spark):
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in VALUES], "v long").select("v", M.vbyte_encode(v).alias("f"), M.vbyte_encode(v, backward=True).alias("b"))
    for x, f, b, df_, db in df.select("v", "f", "b", M.vbyte_decode(F.col("f")), M.vbyte_decode(F.col("b"))).collect():
        g = vbyte(x)
        assert bytes.fromhex(f) == bytes([*g[:-1], g[-1] + 128]) and bytes.fromhex(b) == bytes([g[0] + 128, *g[1:]])
        assert df_ == db == x


def test_reports(spark):
    df = spark.createDataFrame([(999,), (1000,), (1234567,), (5 * 10**9,), (2 * 10**12,)], "v long").select(M.report_space(F.col("v")))
    assert [r[0] for r in df.collect()] == ["999 bytes", "1.00 KB", "1.23 MB", "5.00 GB", "2.00 TB"]
    df = spark.createDataFrame([(2048, 1_000_000), (10, 5)], "b long, t long").select(M.report_speed(F.col("b"), F.col("t")))
    assert [r[0] for r in df.collect()] == ["2.00 KB/s", "2.00 B/us"]
    df = spark.createDataFrame([(5,), (61_001,), (3_600_000,)], "t long").select(M.report_time(F.col("t")))
    assert [r[0] for r in df.collect()] == ["5", "01:01.1", "01:00:00.0"]
    df = spark.createDataFrame([("a:b:",), ("a",), ("a::b",)], "s string").select(M.split_lines(F.col("s"), ":"))
    assert [r[0] for r in df.collect()] == [["a", "b"], ["a"], ["a", "", "b"]]


def test_suffixes(spark):
    df = spark.createDataFrame([("a.txt",), ("b.gz",), ("c",), (None,)], "s string").select(M.ends_with_any(F.col("s"), [".gz", ".txt"]))
    assert [r[0] for r in df.collect()] == [".txt", ".gz", None, None]


def test_entropy(spark):
    row = M.entropy(spark.createDataFrame([(0, 3), (1, 1), (2, 0)], "sym_id long, freq long")).first()
    assert row.total == 4 and abs(row.h0 - (0.75 * math.log2(4 / 3) + 0.5)) < 1e-6


def test_running(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).cast("bigint").alias("v")).repartition(5)
    assert all(r.k == r.nth for r in with_row_index(df, ["k"], "nth").collect())
    assert all(r.s == 2 * r.k for r in with_running_sum(df, ["k"], "v", "s").collect())
