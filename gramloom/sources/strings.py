"""String collections: (str_id, text), from tables or text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.parse import byte_counts
from gramloom.plans.materialize import with_row_index, with_running_sum


def from_text(spark: SparkSession, path: str, *, split_bytes: int | None = None) -> DataFrame:
    """One string a line, in order of file and line; the separator is no part of a string. Files are read in
    splits of whole lines; `split_bytes` is their size."""
    option = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(option)
    if split_bytes:
        spark.conf.set(option, str(split_bytes))
    try:
        lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        # numbering writes the lines, so the splits are done with when it returns
        return with_row_index(numbered, ["file", "block", "line"], "str_id").select("str_id", "text")
    finally:
        spark.conf.set(option, before)


def from_table(df: DataFrame, key: str | list[str], text: str | Column = "text") -> DataFrame:
    """A table's text column. One integer key is the id; several keys are numbered in their order."""
    value = F.col(text) if isinstance(text, str) else text
    if isinstance(key, str):
        return df.select(F.col(key).cast("bigint").alias("str_id"), value.alias("text"))
    return with_row_index(df.select(*key, value.alias("text")), key, "str_id").select("str_id", "text")


def profile(strings: DataFrame, separator: int = 10) -> DataFrame:
    """One row: strings, bytes (a separator each), longest and shortest, empty ones; different bytes, the least and the
    greatest one, and how often the separator stands inside a string."""
    size = F.octet_length("text")
    sizes = strings.agg(
        F.count("*").alias("n_strings"), F.coalesce(F.sum(size + 1), F.lit(0)).cast("bigint").alias("n_bytes"), (F.max(size) + 1).cast("bigint").alias("longest"), (F.min(size) + 1).cast("bigint").alias("shortest"),
        F.sum(F.when(F.coalesce(size, F.lit(0)) == 0, 1).otherwise(0)).cast("bigint").alias("n_empty"))
    symbols = byte_counts(strings).agg(
        F.count("*").alias("alphabet"), F.min("byte").alias("least_byte"), F.max("byte").alias("greatest_byte"),
        F.coalesce(F.sum(F.when(F.col("byte") == separator, F.col("n"))), F.lit(0)).cast("bigint").alias("n_separators"))
    return sizes.join(symbols, F.lit(True))  # each is one row of sums


def offsets(strings: DataFrame) -> DataFrame:
    """(str_id, start, size): where each string begins in the concatenation, with a separator after each."""
    sized = strings.select("str_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"))
    return with_running_sum(sized, ["str_id"], "size", "start").select("str_id", "start", "size")


def coordinates(queries: DataFrame, column: str = "query") -> DataFrame:
    """ "STR:START-END" to (query, str_id, start, stop); null numbers where a part is missing or no number."""
    whole = F.regexp_extract(column, r"^(\d+):(\d+)-(\d+)$", 0) != ""
    part = lambda i: F.when(whole, F.regexp_extract(column, r"^(\d+):(\d+)-(\d+)$", i)).cast("bigint")
    return queries.select(F.col(column).alias("query"), part(1).alias("str_id"), part(2).alias("start"), part(3).alias("stop"))
