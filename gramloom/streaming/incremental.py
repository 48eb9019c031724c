"""Incremental builds: strings arrive in micro-batches, rules that are not known yet are appended.

State is the rules table. Rules are told by content, so the result doesn't depend on how strings
fall into batches or on their order. A batch writes to a folder of its own number, so a batch that
is run again after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gramloom.operators.grammar import Grammar
from gramloom.operators.parse import build_rows
from gramloom.plans.materialize import materialize

RULES = "lvl int, fp binary, rhs binary, len bigint, batch bigint"
STRINGS = "str_id bigint, lvl int, fp binary, len bigint, batch bigint"


def _state(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(kind).parquet(path)


def add_batch(strings: DataFrame, batch: int, path: str) -> None:
    """Append a batch's strings, and the rules that earlier batches don't have. A batch is dealt over the tasks before
    it is parsed, as a file of it can be one task's; what is parsed is written once."""
    spark = strings.sparkSession
    rows = materialize(build_rows(strings.repartition("str_id")).distinct(), "batch")
    rules = rows.where("rhs is not null").select("lvl", "fp", "rhs", "len")
    had = _state(spark, f"{path}/rules", RULES)
    if had is not None:
        rules = rules.join(had.where(had["batch"] != batch).select("lvl", "fp"), ["lvl", "fp"], "left_anti")
    rules.write.mode("overwrite").parquet(f"{path}/rules/batch={batch}")
    rows.where("rhs is null").select("str_id", "lvl", "fp", "len").write.mode("overwrite").parquet(f"{path}/strings/batch={batch}")


def build_stream(spark: SparkSession, source: str, schema: str | StructType, path: str, *, files_at_once: int = 1) -> None:
    """Read (str_id, text) from the Parquet files under `source` as they come, until none is left, into the
    grammar under `path`; go on from the last checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: add_batch(df, i, path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def load_state(spark: SparkSession, path: str) -> Grammar:
    return Grammar(_state(spark, f"{path}/rules", RULES).drop("batch"), _state(spark, f"{path}/strings", STRINGS).drop("batch"))
