"""Lineage cuts and distributed running numbers.

What is read more than once is written once, as Parquet in the folder that the session names in
spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary folder; a cluster,
whose executors would each write to their own, gets an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if (app := spark.sparkContext.applicationId) not in _own:
        _own[app] = tempfile.mkdtemp(prefix="gramloom-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", path: str | None = None, by: str | None = None) -> DataFrame:
    """df, written once and read back; its shuffle files go as soon as it is written. `by`: an int column to partition by."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df in range partitions by the order, with __p (partition) and __i (place in it), written once
    so that both stay what they are."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = laid.withColumn("__m", F.monotonically_increasing_id())
    split = numbered.withColumn("__p", F.shiftright("__m", 33).cast("int")).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m")
    return materialize(split, name)


def _offsets(laid: DataFrame, value: Column) -> DataFrame:
    """(__q, __before): what comes before each partition; a row for each partition, not for each row."""
    sums = laid.groupBy(F.col("__p").alias("__q")).agg(value.alias("__v"))
    return sums.select("__q", (F.sum("__v").over(Window.orderBy("__q")) - F.col("__v")).alias("__before"))


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """df with a column `name`: 0, 1, … in the given order, without a window over everything."""
    laid = _ranged(df, order, name)
    before = _offsets(laid, F.count("*"))
    return laid.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__q", "__before")


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with a column `name`: the sum of `value` over all rows before, in the given order."""
    laid = _ranged(df, order, name)
    before = _offsets(laid, F.sum(value))
    here = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumn("__s", F.sum(value).over(here) - F.col(value))
    return summed.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, (F.col("__before") + F.col("__s")).cast("bigint")).drop("__p", "__i", "__q", "__before", "__s")
