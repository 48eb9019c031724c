"""Connected components of a graph of 64-bit nodes, by alternating large and small stars.

Each round hangs every node's larger neighbours on its least one, then its smaller ones; the
graph becomes stars after a number of rounds that grows with the logarithm of the longest
path. Rounds are joins and partial minima, so the hub of a large component is summed up
before it is shuffled, and a join splits its rows among tasks. Each round is cut and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the least node of the component of each node but the roots. Loops, null
    ends and repeated edges count for nothing; no edges give no rows."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node's smaller neighbours and itself on the least of them
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        hung = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = cut(hung.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components not found in {ROUNDS} rounds")
