"""Helpers shared by the training-data operators: let-bindings and running sums
for array expressions, lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.plans.materialize import scratch

#: Word patterns of the contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row.

    The optimizer may copy a projected column into every lambda that reads it;
    a lambda variable can't be copied, so arrays bound here are computed once.
    """
    return F.transform(F.array(value), body)[0]


def indices(n: Column) -> Column:
    """array 0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


_BLOCK = 256


def running_starts(lengths: Column) -> Column:
    """Exclusive running sums of array<bigint>; in blocks, so that long arrays
    cost n * 256 steps and not n squared."""

    def sums(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(a, zero, lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["o"], F.array(t["s"])).alias("o")))

    def whole(a: Column) -> Column:
        blocks = F.transform(indices(F.ceil(F.size(a) / _BLOCK)), lambda b: sums(F.slice(a, b * _BLOCK + 1, _BLOCK)))
        return let(blocks, lambda bs: let(
            sums(F.transform(bs, lambda b: b["s"])),
            lambda tops: F.flatten(F.zip_with(bs, tops["o"], lambda b, t: F.transform(b["o"], lambda v: v + t)))))

    return let(lengths, whole)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other letter changes. lower() is the faster way where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, the checkpoint folder of the context, or on a local
    master (tests) a temporary one; a cluster without any gets an error."""
    ctx = spark.sparkContext._jsc.sc()
    if spark.conf.get("spark.checkpoint.dir", None) is None and ctx.getCheckpointDir().isDefined():
        return ctx.getCheckpointDir().get()
    path = scratch(spark)
    if ctx.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that a Python worker and its executor hold at once, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session: whole texts are long, and the default of
    10,000 rows puts tens of megabytes in each executor's and each worker's buffers."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(BATCH_ROWS))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """As cut(), as Parquet: for wide or many rows, whose columns are then read one by one. The
    shuffle files of what was written go at once, not when the driver happens to collect garbage."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/gramloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
