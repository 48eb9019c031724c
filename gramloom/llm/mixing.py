"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: a budget of words is shared by weight; what exceeds a source's cap goes to the
   others by weight until none is above. A round of sharing is two sums over the sources.
2. Blocks: the documents of a source fall into BLOCKS blocks by a keyed hash, and blocks are
   put in a keyed order, anew for each epoch. A source's quota takes whole epochs first and
   then blocks in that order; the block that the quota ends in is taken document by document,
   the last document in part, so quotas are met to the word.
3. Splitting tree: the blocks taken are counted by source, and the vector of counts is split
   between the two halves of the output shards, again and again, each time by a
   multivariate-hypergeometric draw (each block goes left with the chance that the places
   left over give, which is the exact law). The leaves hold each shard's quota by source.
   Sources are drawn in groups first, and then each group's among its sources by a tree of its
   own, whose shards have the places that the group got: the same law, and no task has more
   sources than about the root of their number.
4. A shard takes that many of the source's blocks, the next ones in the keyed order, so
   shards are disjoint; within a shard rows carry a random key to sort by.

Only built-in expressions. What is one row, or one window, is per source and block, never per
document: BLOCKS * 2 rows a source; documents of the blocks that a quota ends in are ordered
within their block. A hot source is BLOCKS groups.

Null text has no words; null source is a source, the last one. Documents without words, and
those of sources without words, are never taken (0 words). Repeated rows are documents of
their own; which of equal ones is taken doesn't show. An empty table gives no rows. Reruns agree: draws depend on the ids, the texts and
the seed alone. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.llm.common import SPACE_RUN, cut, let
from gramloom.plans.materialize import with_row_index

BLOCKS = 256
SHARDS = 16
#: Sources up to which their targets are broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000
#: Fixed values of the contract.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE_RUN, -1), "")).cast("bigint")


def weigh_by_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) with a column weight: the weights in turn, by code point, null last."""
    ranked = with_row_index(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "rank").drop("none")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")


def targets(sources: DataFrame, *, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size, weight) with a column target: the least of cap * size and level * weight, where
    the targets add up to share * all sizes (or all caps, if that is less)."""
    x = sources.withColumn("cap", F.col("size") * F.lit(float(cap)))
    words, weight = x.agg(F.sum("size"), F.sum("weight")).first()
    level, known = (share * words / weight if weight else None), 0
    while level is not None:
        is_full = F.col("cap") / F.col("weight") < F.lit(level)
        n, full, open_ = x.agg(F.count(F.when(is_full, 1)), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == known:
            break
        known, level = n, ((share * words - full) / open_ if open_ else None)
    return x.select("source", "size", "weight", F.least("cap", F.lit(level).cast("double") * F.col("weight")).alias("target"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(names: array, quota: array<bigint>) -> (shard, names, quota), for each row: disjoint parts that add up to
    it, drawn by the splitting tree. Their sizes are those in a column `places` (array<bigint>, one a
    shard), or without it as equal as can be; a column `part` makes rows draw on their own, and is kept."""

    def draw(n: Column, take: Column, lo: Column, hi: Column) -> Column:
        # each block of source i goes left with chance (places left) / (blocks left)
        def one(state: Column, x: Column, i: Column) -> Column:
            zero = F.struct(state["take"].alias("take"), state["rest"].alias("rest"), F.lit(0).cast("bigint").alias("got"))

            def ball(s: Column, j: Column) -> Column:
                hit = F.pmod(F.xxhash64(F.lit(seed), "part", lo, hi, i, j), s["rest"]) < s["take"]
                d = F.when(hit, 1).otherwise(0).cast("bigint")
                return F.struct((s["take"] - d).alias("take"), (s["rest"] - 1).alias("rest"), (s["got"] + d).alias("got"))

            return let(F.aggregate(F.when(x > 0, F.sequence(F.lit(1).cast("bigint"), x)).otherwise(F.array().cast("array<bigint>")), zero, ball), lambda r: F.struct(
                r["take"].alias("take"), r["rest"].alias("rest"), F.concat(state["out"], F.array(r["got"])).alias("out")))

        start = F.struct(take.alias("take"), F.aggregate(n, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("rest"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.transform(n, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, lambda s, e: one(s, e["x"], e["i"]), lambda s: s["out"])

    total = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, b: a + b)
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(total / shards) + F.when(i < total % shards, 1).otherwise(0))
    part = F.col("part") if "part" in quotas.columns else F.lit(-1)
    places = F.col("places") if "places" in quotas.columns else even
    nodes = quotas.select(part.cast("bigint").alias("part"), places.cast("array<bigint>").alias("places"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "names", "quota")
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        here = F.aggregate(F.slice("places", F.col("lo") + 1, mid - F.col("lo")), F.lit(0).cast("bigint"), lambda a, b: a + b)
        halves = let(draw(F.col("quota"), here, F.col("lo"), F.col("hi")), lambda left: F.array(
            F.struct(F.col("lo").alias("lo"), mid.alias("hi"), left.alias("quota")),
            F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("quota", left, lambda a, b: a - b).alias("quota"))))
        same = F.array(F.struct(F.col("lo"), F.col("hi"), F.col("quota")))
        nodes = nodes.select("part", "places", "names", F.explode_outer(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(same)).alias("n")).select("part", "places", "names", "n.*")
    return nodes.select(F.col("lo").alias("shard"), *(["part"] if "part" in quotas.columns else []), "names", "quota")


def split_sources(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, n), a row for each source -> (shard, s, n): the splitting tree over groups of sources, and then
    one over the sources of each group."""
    groups = max(1, math.isqrt(counts.count()))
    lists = lambda name: F.sort_array(F.collect_list(F.struct(name, "n")))
    arrays = lambda name: (F.transform("l", lambda x: x[name]).alias("names"), F.transform("l", lambda x: x["n"]).alias("quota"))
    inner = cut(counts.groupBy(F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(groups)).cast("bigint").alias("part")).agg(lists("source").alias("l"), F.sum("n").alias("n")))
    top = split_tree(inner.groupBy().agg(lists("part").alias("l")).select(*arrays("part")), shards, seed)
    pairs = top.select("shard", F.explode(F.arrays_zip("names", "quota")).alias("p")).select(F.col("p.names").alias("part"), "shard", F.col("p.quota").alias("n"))
    places = pairs.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("places"))
    leaves = split_tree(inner.join(places, "part").select("part", "places", *arrays("source")), shards, seed)
    return leaves.select("shard", F.explode(F.arrays_zip("names", "quota")).alias("p")).select("shard", F.col("p.names").alias("s"), F.col("p.quota").alias("n"))


def mix(documents: DataFrame, *, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(docs, taken). docs: uid, doc_id, source, size, source_size, target of every row. taken: uid, source,
    epoch, shard, key, words: a row for each document taken in an epoch, with the words that are taken of it
    (its first ones); the output of a shard is its rows in order of key."""
    keyed = lambda *c: F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in c], F.lit(str(seed))))
    text = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")).alias("k"))
    docs = cut(text.select(F.monotonically_increasing_id().alias("uid"), "*", F.pmod(F.conv(F.substring(keyed("k"), 1, 8), 16, 10).cast("bigint"), F.lit(blocks)).cast("int").alias("block")))
    filled = cut(docs.groupBy("source", "block").agg(F.sum("size").alias("words")))
    goal = cut(targets(weigh_by_order(filled.groupBy("source").agg(F.sum("words").alias("size")), weights), share=share, cap=cap))

    # blocks in keyed order, an epoch after the other
    epochs = int(-(-cap // 1))
    quota = F.floor("target").cast("bigint")
    one = filled.where("words > 0").join(goal.select(F.col("source").alias("s"), "size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = one.select("source", "block", "words", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    order = Window.partitionBy("source").orderBy("epoch", keyed("source", "epoch", "block"), "block")
    laid = laid.select("source", "block", "words", "epoch", F.row_number().over(order).alias("rank"), (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("start"), quota.alias("quota"))
    drawn = laid.where("start < quota").select("source", "block", "epoch", "rank", F.least(F.col("words"), F.col("quota") - F.col("start")).alias("take"), (F.col("start") + F.col("words") > F.col("quota")).alias("last"))
    drawn = cut(drawn)

    # shards by the tree
    parts = split_sources(drawn.groupBy("source").agg(F.count("*").alias("n")), shards, seed)
    upto = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("shard", "s", F.sum("n").over(upto).alias("to"), (F.sum("n").over(upto) - F.col("n")).alias("from"))
    placed = drawn.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("to"))).drop("s", "from", "to")

    row = docs.where("size > 0").select("uid", "doc_id", "k", F.col("source").alias("s"), F.col("block").alias("b"), "size")
    got = row.join(placed, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block")))
    fill = Window.partitionBy("source", "block", "epoch").orderBy(keyed("k", "epoch"), "doc_id", "uid")
    ended = got.where("last").withColumn("start", F.sum("size").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ended = ended.where("start < take").withColumn("words", F.least(F.col("size"), F.col("take") - F.col("start"))).drop("start")
    taken = got.where("not last").withColumn("words", F.col("size")).unionByName(ended)
    taken = taken.select("uid", "source", "epoch", "shard", keyed("k", "epoch", "shard").alias("key"), "words")
    goal = goal.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    full = docs.join(F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return full, taken


def op6_source_mixing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: for each document the words that the mix takes."""
    docs, taken = mix(documents)
    words = taken.groupBy(F.col("uid").alias("u")).agg(F.sum("words").alias("taken"))
    return docs.join(words, F.col("uid") == F.col("u"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
