"""A grammar on disk: a Parquet table for each part, rules by level, and one row of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.access import Sampled, load_sampled, sample
from gramloom.operators.grammar import Grammar, Packed, size_row


def save(g: Grammar, path: str) -> None:
    """Content-addressed form; rules are partitioned by level, so one level is read alone."""
    g.rules.write.mode("overwrite").partitionBy("lvl").parquet(f"{path}/rules")
    g.strings.write.mode("overwrite").parquet(f"{path}/strings")


def load(spark: SparkSession, path: str) -> Grammar:
    rules = spark.read.parquet(f"{path}/rules").select(F.col("lvl").cast("int"), "fp", "rhs", "len")
    return Grammar(rules, spark.read.parquet(f"{path}/strings"))


def save_packed(p: Packed, path: str, *, simplified: bool, random_access: bool) -> None:
    """Dense form; with random access also its sampled form, that substring queries read."""
    for name in ("sym", "rhs", "roots", "rl"):
        getattr(p, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if random_access:
        sample(p, path)
    size_row(p).select("*", F.lit(p.n_rl > 0).alias("has_rl"), F.lit(simplified).alias("simplified"), F.lit(random_access).alias("has_ra")).write.mode("overwrite").parquet(f"{path}/meta")


def load_packed(spark: SparkSession, path: str) -> Packed:
    m = metadata(spark, path).first()
    return Packed(*[spark.read.parquet(f"{path}/{x}") for x in ("sym", "rhs", "roots", "rl")], n_rules=m["n_lc"], n_rl=m["n_rl"], n_strings=m["s"], n=m["n"])


def load_samples(spark: SparkSession, path: str) -> Sampled:
    """The sampled form of a stored grammar; an error if it was stored without."""
    if not metadata(spark, path).first()["has_ra"]:
        raise ValueError(f"{path} was stored without random access")
    return load_sampled(spark, path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sizes and flags of a stored grammar, without a look at its rules."""
    return spark.read.parquet(f"{path}/meta")
