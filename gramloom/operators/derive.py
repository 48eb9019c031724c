"""Expansion: from symbols back to bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators.access import Sampled, expand
from gramloom.operators.grammar import Packed, with_starts
from gramloom.plans.materialize import materialize


def _joined(rows: DataFrame, owner: str, texts: DataFrame) -> DataFrame:
    """(owner, hex): the children's texts in order of pos."""
    t = texts.select(F.col("sym_id").alias("s"), F.col("hex").alias("h"))
    return rows.join(t, F.col("child") == F.col("s")).groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("xs")).select(owner, F.array_join(F.transform("xs", lambda x: x["h"]), "").alias("hex"))


def expansions(p: Packed, most: int | None = None) -> DataFrame:
    """(sym_id, hex): the bytes of every symbol, or of those up to a level. From below, level by level, so a text that
    several rules share is spelled once; a rule's children can be of any level below it."""
    texts = p.sym.where("kind = 't'").select("sym_id", F.lpad(F.hex("byte"), 2, "0").alias("hex"))
    level = p.sym.select(F.col("sym_id").alias("id"), "lvl", "kind")
    rhs = materialize(p.rhs.join(level, F.col("owner") == F.col("id")).select("owner", "lvl", "pos", "child"), "by_level")
    rl = p.rl.join(level, F.col("sym_id") == F.col("id")).select("sym_id", "lvl", "child", "run_len")
    top = rhs.agg(F.max("lvl")).first()[0] or 0
    done = texts
    for lvl in range(0, (top if most is None else min(top, most)) + 1):
        fresh = texts if lvl == 0 else materialize(_joined(rhs.where(F.col("lvl") == lvl), "owner", done).withColumnRenamed("owner", "sym_id"), "texts")
        t = fresh.select(F.col("sym_id").alias("s"), F.col("hex").alias("h"))
        runs = rl.where(F.col("lvl") == lvl).join(t, F.col("child") == F.col("s")).select("sym_id", F.expr("repeat(h, cast(run_len as int))").alias("hex"))
        done = (fresh if lvl == 0 else done.unionByName(fresh)).unionByName(runs)
    return done


def decompress(s: Sampled) -> DataFrame:
    """(str_id, hex) of every string that has bytes: from the strings down to short symbols, so no text of a longer
    rule is ever spelled."""
    return expand(s).select("str_id", F.hex("bytes").alias("hex"))


def verify(s: Sampled, strings: DataFrame) -> DataFrame:
    """One row: strings, those whose expansion is equal to their text, bytes of the expansions."""
    want = strings.select(F.col("str_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("want"))
    both = want.join(expand(s), F.col("id") == F.col("str_id"), "left").select("want", F.coalesce("bytes", F.lit(b"")).alias("got"))
    return both.agg(F.count("*").alias("n_strings"), F.sum(F.when(F.col("want") == F.col("got"), 1).otherwise(0)).cast("bigint").alias("n_equal"), F.sum(F.octet_length("got")).cast("bigint").alias("n_bytes"))


def parse_tree(p: Packed, depth: int | None = None) -> DataFrame:
    """(str_id, depth, pos, sym_id, start): the nodes of the strings' parse trees, down to the terminals or to a
    depth; pos is the place under the parent, start the offset of the node's first byte. Nodes are joined with
    bodies once for each step down, and a step is written before the next one."""
    rl = p.rl.join(p.sym.select(F.col("sym_id").alias("c"), F.col("len").alias("one")), F.col("child") == F.col("c"))
    copies = rl.select(F.col("sym_id").alias("owner"), "child", "one", F.explode(F.expr("sequence(0L, run_len - 1)")).alias("pos")).select("owner", "pos", "child", (F.col("pos") * F.col("one")).alias("off"))
    bodies = lambda df, owner: with_starts(df, owner).select(owner, F.col("pos").cast("bigint").alias("pos"), "child", F.col("start").alias("off"))
    rules = materialize(bodies(p.rhs, "owner").unionByName(copies), "offsets")
    now = materialize(bodies(p.roots, "str_id").select("str_id", F.lit(1).alias("depth"), "pos", F.col("child").alias("sym_id"), F.col("off").alias("start")), "nodes")
    out, d = now, 1
    while d != depth and not now.isEmpty():
        d += 1
        below = rules.withColumnRenamed("pos", "place")
        now = materialize(now.join(below, F.col("sym_id") == F.col("owner")).select("str_id", F.lit(d).alias("depth"), F.col("place").alias("pos"), F.col("child").alias("sym_id"), (F.col("start") + F.col("off")).alias("start")), "nodes")
        out = out.unionByName(now)
    return out


def lcp(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, lcp, cmp): bytes that two strings' expansions have in common at their beginnings, and which one comes first
    byte by byte (-1: a, 0: they are equal, 1: b); texts: (str_id, hex)."""
    x, y = texts.select(F.col("str_id").alias("a"), F.col("hex").alias("x")), texts.select(F.col("str_id").alias("b"), F.col("hex").alias("y"))
    # halves of the longest possible prefix, by equality of whole slices: a search over lengths, not over positions
    n = F.least(F.octet_length("x"), F.octet_length("y")) / 2
    step = "aggregate(sequence(0, 40), named_struct('lo', cast(0 as bigint), 'hi', cast(n as bigint)), (s, i) -> if(s.lo >= s.hi, s, if(substring(x, 1, cast(2 * ((s.lo + s.hi + 1) div 2) as int)) = substring(y, 1, cast(2 * ((s.lo + s.hi + 1) div 2) as int)), named_struct('lo', (s.lo + s.hi + 1) div 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi + 1) div 2 - 1))), s -> s.lo)"
    return pairs.join(x, "a").join(y, "b").withColumn("n", n.cast("bigint")).select("a", "b", F.expr(step).alias("lcp"), F.when(F.col("x") < F.col("y"), -1).when(F.col("x") == F.col("y"), 0).otherwise(1).alias("cmp"))
