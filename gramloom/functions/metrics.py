"""Bit and byte widths, variable-byte codes, sizes and rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.plans.materialize import with_row_index


def bit_width(v: Column) -> Column:
    """Bits of a number that is not negative; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v))).cast("int")


def next_power_of_two(v: Column) -> Column:
    """The least power of two above v."""
    return F.pow(F.lit(2), bit_width(v)).cast("bigint")


def prev_power_of_two(v: Column) -> Column:
    """The greatest power of two up to v; null for 0, which has none."""
    return F.when(v > 0, F.pow(F.lit(2), bit_width(v) - 1).cast("bigint"))


def is_power_of_two(v: Column) -> Column:
    """At most one bit is set; so 0 counts."""
    return v.bitwiseAND(v - 1) == 0


def round_to_power_of_two(v: Column) -> Column:
    return F.when(is_power_of_two(v), v).otherwise(next_power_of_two(v))


def int_ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("bigint")


def vbyte_len(v: Column) -> Column:
    """Bytes of a number in groups of 7 bits, 1 for 0."""
    return int_ceil(F.greatest(bit_width(v), F.lit(1)), 7)


def vbyte_groups(v: Column) -> Column:
    """array<int>: the 7-bit groups, lowest first."""
    return F.transform(F.sequence(F.lit(0), (vbyte_len(v) - 1).cast("int")), lambda i: F.pmod(F.floor(v / F.pow(F.lit(2), i * 7)), F.lit(128)).cast("int"))


def vbyte_encode(v: Column, *, backward: bool = False) -> Column:
    """The code as hex: groups lowest first; the byte with 128 added ends a code that is read forward, and begins one
    that is read backward."""
    g = vbyte_groups(v)
    mark = lambda x, i: x + F.when(i == (F.lit(0) if backward else F.size(g) - 1), 128).otherwise(0)
    return F.array_join(F.transform(g, lambda x, i: F.lpad(F.hex(mark(x, i)), 2, "0")), "")


def vbyte_decode(code: Column) -> Column:
    """The number of a code of either direction."""
    n = F.octet_length(code) / 2
    return F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), F.lit(0).cast("bigint"), lambda a, i: a + (
        F.pmod(F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(128)) * F.pow(F.lit(2), i * 7)).cast("bigint"))


def _fixed(v: Column) -> Column:
    return F.format_string("%.2f", v.cast("double"))


def report_space(v: Column) -> Column:
    """Bytes in decimal units with two digits, halves up; whole bytes below a thousand."""
    out = F.concat(v.cast("string"), F.lit(" bytes"))
    for unit, name in ((10**3, "KB"), (10**6, "MB"), (10**9, "GB"), (10**12, "TB")):
        cents = F.floor((v + unit // 200) / (unit // 100)).cast("bigint")
        out = F.when(v >= unit, F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {name}"))).otherwise(out)
    return out


def report_speed(size: Column, micros: Column) -> Column:
    """Bytes in binary units by time in its own largest unit, two digits."""
    b, bu, t, tu = size.cast("double"), F.lit("B"), micros.cast("double"), F.lit("us")
    for i, name in enumerate(("KB", "MB", "GB", "TB"), 1):
        bu = F.when(size >= 1024**i, F.lit(name)).otherwise(bu)
        b = F.when(size >= 1024**i, size / 1024**i).otherwise(b)
    unit = 1
    for scale, name in ((1000, "ms"), (1000, "s"), (60, "min"), (60, "h")):
        unit *= scale
        tu = F.when(micros >= unit, F.lit(name)).otherwise(tu)
        t = F.when(micros >= unit, micros / unit).otherwise(t)
    return F.concat(_fixed(b / t), F.lit(" "), bu, F.lit("/"), tu)


def report_time(millis: Column) -> Column:
    """Elapsed time as hh:mm:ss.ms, without the leading units that are zero."""
    h, m, s, ms = F.floor(millis / 3600000), F.floor(millis / 60000) % 60, F.floor(millis / 1000) % 60, millis % 1000
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s), F.lit("."), ms.cast("string"))).when(
        m > 0, F.concat(two(m), F.lit(":"), two(s), F.lit("."), ms.cast("string"))).when(s > 0, F.concat(s.cast("string"), F.lit("."), ms.cast("string"))).otherwise(ms.cast("string"))


def split_lines(v: Column, delimiter: str) -> Column:
    """Parts between one-character delimiters; no empty part after the last one."""
    parts = F.split(v, f"\\Q{delimiter}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ends_with_any(v: Column, suffixes: list[str]) -> Column:
    """The first of the suffixes that the string ends with; null if none does."""
    return F.coalesce(*[F.when(F.endswith(v, F.lit(x)), F.lit(x)) for x in suffixes])


def entropy(counts: DataFrame, n: str = "freq") -> DataFrame:
    """One row: total, h0 (bits per symbol of order zero), nh0 (bits of all)."""
    total = counts.agg(F.sum(n).alias("t"))
    x = counts.where(F.col(n) > 0).join(F.broadcast(total), F.lit(True))  # total: one row
    p = F.col(n) / F.col("t")
    return x.agg(F.first("t").alias("total"), F.sum(p * F.log2(1 / p)).alias("h0")).select("total", F.round("h0", 6).alias("h0"), F.round(F.col("total") * F.col("h0"), 2).alias("nh0"))


def code_sizes(freqs: DataFrame) -> DataFrame:
    """One row: bytes of all occurrences in variable-byte codes, with symbols numbered in order of id and in order of
    frequency (the most frequent first, ties by id). freqs: sym_id, freq."""
    ranked = with_row_index(freqs.select("sym_id", (-F.col("freq")).alias("minus")), ["minus", "sym_id"], "rank")
    numbered = with_row_index(ranked, ["sym_id"], "nth")
    # the code of a number takes its bits and a bit for each byte of them
    cost = lambda c: int_ceil(int_ceil(bit_width(c), 8) + bit_width(c), 8)
    return numbered.agg(
        F.sum(cost(F.col("nth") + 1) * -F.col("minus")).cast("bigint").alias("by_id"), F.sum(cost(F.col("rank") + 1) * -F.col("minus")).cast("bigint").alias("by_frequency"))
