"""Two grammars: what they share, what is new, and where new rules stand among old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators.grammar import Grammar
from gramloom.plans.materialize import with_running_sum

KEY = ["lvl", "fp"]


def marks(a: Grammar, b: Grammar) -> DataFrame:
    """(lvl, fp, mark): 1 only in a, 2 only in b, 3 in both."""
    x, y = a.rules.select(*KEY, F.lit(1).alias("x")), b.rules.select(*KEY, F.lit(2).alias("y"))
    return x.join(y, KEY, "full_outer").select(*KEY, (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("mark"))


def known_rules(old: Grammar, new: Grammar) -> DataFrame:
    return new.rules.join(old.rules.select(*KEY), KEY, "left_semi")


def new_rules(old: Grammar, new: Grammar) -> DataFrame:
    return new.rules.join(old.rules.select(*KEY), KEY, "left_anti")


def placement(old: Grammar, new: Grammar) -> DataFrame:
    """(lvl, fp, place): for each rule that only `new` has, how many rules of its level in `old` have a lesser
    fingerprint; by one sort of both, so no rule is compared with all."""
    both = old.rules.select("lvl", "fp", F.lit(1).cast("bigint").alias("old")).unionByName(new_rules(old, new).select("lvl", "fp", F.lit(0).cast("bigint").alias("old")))
    before = with_running_sum(both, ["lvl", "fp"], "old", "before")
    levels = old.rules.groupBy("lvl").agg(F.count("*").alias("n"))
    base = levels.join(levels.select(F.col("lvl").alias("l"), F.col("n").alias("m")), F.col("l") < F.col("lvl"), "left").groupBy("lvl").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("base"))  # a row for each level
    top = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("every"))
    placed = before.where("old = 0").join(F.broadcast(base), "lvl", "left").join(F.broadcast(top), F.lit(True))
    # a level that the old grammar doesn't have is above all of its levels
    return placed.select("lvl", "fp", (F.col("before") - F.coalesce("base", "every")).alias("place"))
