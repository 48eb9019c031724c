"""Substring queries on a sampled grammar, and whole expansions as the largest of them.

Bodies are laid out once, in chunks of as many children as the sample rate: a chunk is a row with the
bytes before it (the sampled prefix sum), its size and its children, runs spelled as (child, times).
Rules are partitioned by level, so a step reads the rules of one level only and each level once.
Symbols of at most SHORT bytes have their text beside them, so a query ends where its nodes are short.

A query is a node with a range. A step joins the nodes of a level with the chunks of their symbols
that the range meets; the planner broadcasts the nodes if the size of their table is small, so a few
queries on a large grammar move no bodies. Coordinates count from 0, the end belongs to the range;
what is beyond the string's end is cut off, and unknown strings and ranges that begin beyond the end
give no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.operators.grammar import Packed, with_starts
from gramloom.plans.materialize import fresh_path, materialize

RULE_RATE, STRING_RATE = 4, 8
#: Bytes up to which a symbol's text is stored.
SHORT = 64


def laid_out(rhs: DataFrame, owner: str) -> DataFrame:
    """(owner, pos, child, len, end): children with the running sum of their lengths."""
    w = Window.partitionBy(owner).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rhs.select(owner, "pos", "child", "len").withColumn("end", F.sum("len").over(w))


def rule_samples(p: Packed, rate: int = RULE_RATE) -> DataFrame:
    """(sym_id, pos, acc): expansion length of the first pos children, for each pos-th and for all; of a run-length rule
    for all."""
    ends = laid_out(p.rhs, "owner").withColumn("n", F.max("pos").over(Window.partitionBy("owner")))
    some = ends.where(((F.col("pos") + 1) % rate == 0) | (F.col("pos") == F.col("n"))).select(F.col("owner").alias("sym_id"), (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("end").alias("acc"))
    rl = p.rl.join(p.sym.select("sym_id", "len"), "sym_id").select("sym_id", F.col("run_len").alias("pos"), F.col("len").alias("acc"))
    return some.unionByName(rl)


def string_samples(p: Packed, rate: int = STRING_RATE) -> DataFrame:
    """(str_id, pos, acc) for each pos-th child of a string."""
    ends = laid_out(p.roots, "str_id")
    return ends.where((F.col("pos") + 1) % rate == 0).select("str_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("end").alias("acc"))


# ---- the sampled form


@dataclass(frozen=True)
class Sampled:
    """strings and rules (owner, start, size, kids), rules with lvl; kids: array<struct<pos, child, lvl, one, run>>, one the
    bytes of one child, run how many of it. texts (sym_id, text) of the symbols of at most SHORT bytes. heights: the levels
    that have rules."""

    strings: DataFrame
    rules: DataFrame
    texts: DataFrame
    heights: list[int]


def _level_of(p: Packed) -> Column | None:
    """The level of the symbol `child`, from the first id of each level: rules are numbered level by level."""
    firsts = p.sym.where("kind = 'lc'").groupBy("lvl").agg(F.min("sym_id").alias("low")).orderBy(F.desc("low")).collect()  # a row for each level
    out = None
    for r in firsts:
        here = F.col("child") >= r["low"]
        out = F.when(here, r["lvl"]) if out is None else out.when(here, r["lvl"])
    return F.lit(0) if out is None else out.otherwise(0)


def _unfolded(p: Packed, body: DataFrame, owner: str, level: Column) -> DataFrame:
    """(owner, pos, start, child, lvl, one, run): children with run-length symbols, whose ids are the last ones, replaced by
    what they repeat; only those are joined."""
    rows = with_starts(body, owner).select(F.col(owner).alias("owner"), "pos", "start", "child", "len")
    low = p.rl.agg(F.min("sym_id")).first()[0] if p.n_rl else None
    alone = rows if low is None else rows.where(F.col("child") < low)
    plain = alone.select("owner", "pos", "start", "child", F.lit(1).cast("bigint").alias("run"), "len")
    if low is not None:
        rl = p.rl.select(F.col("sym_id").alias("rl_id"), F.col("child").alias("rl_child"), "run_len")
        repeated = rows.where(F.col("child") >= low).join(rl, F.col("child") == F.col("rl_id"))
        plain = plain.unionByName(repeated.select("owner", "pos", "start", F.col("rl_child").alias("child"), F.col("run_len").cast("bigint").alias("run"), "len"))
    return plain.select("owner", "pos", "start", "child", level.alias("lvl"), F.expr("len div run").alias("one"), "run")


def _chunks(rows: DataFrame, rate: int) -> DataFrame:
    """(owner, start, size, kids): one shuffle by owner."""
    kid = F.struct("pos", "child", "lvl", "one", "run")
    chunks = rows.repartition("owner").groupBy("owner", F.expr(f"pos div {rate}").alias("chunk")).agg(
        F.min("start").alias("start"), F.sum(F.col("one") * F.col("run")).alias("size"), F.sort_array(F.collect_list(kid)).alias("kids"))
    return chunks.select("owner", "start", "size", "kids")


def joined_text(parts: Column) -> Column:
    """The texts of array<struct<order, text: binary>> in order, as one binary."""
    return F.array_join(F.transform(F.sort_array(parts), lambda x: x["text"].cast("string")), "").cast("binary")


def _short_texts(p: Packed, rows: DataFrame) -> DataFrame:
    """(sym_id, text) of terminals and of rules of at most SHORT bytes, from below, level by level."""
    done = p.sym.where("kind = 't'").select("sym_id", F.unhex(F.lpad(F.hex("byte"), 2, "0")).alias("text"))
    short = p.sym.where(f"kind = 'lc' and len <= {SHORT}").select(F.col("sym_id").alias("id"), F.col("lvl").alias("of"))
    bodies = materialize(rows.join(short, F.col("owner") == F.col("id")).select("owner", "of", "pos", "child", "run"), "short")
    for r in bodies.select("of").distinct().orderBy("of").collect():  # a row for each level
        t = done.select(F.col("sym_id").alias("s"), "text")
        part = F.struct("pos", F.expr("cast(repeat(cast(text as string), cast(run as int)) as binary)").alias("text"))
        spelled = bodies.where(F.col("of") == r["of"]).join(t, F.col("child") == F.col("s")).groupBy(F.col("owner").alias("sym_id")).agg(joined_text(F.collect_list(part)).alias("text"))
        done = done.unionByName(materialize(spelled, "texts"))
    return done


def sample(p: Packed, path: str | None = None) -> Sampled:
    """The sampled form of a packed grammar, written below a path (in the shared folder if there is none)."""
    path = path or fresh_path(p.spark, "sampled")
    level = _level_of(p)
    rules = _unfolded(p, p.rhs, "owner", level)
    own = level if isinstance(level, Column) else F.lit(0)
    chunks = _chunks(rules, RULE_RATE).withColumn("child", F.col("owner")).withColumn("lvl", own).drop("child")
    chunks.sortWithinPartitions("lvl", "owner").write.mode("overwrite").partitionBy("lvl").parquet(f"{path}/rule_bodies")
    _chunks(_unfolded(p, p.roots, "str_id", level), STRING_RATE).sortWithinPartitions("owner", "start").write.mode("overwrite").parquet(f"{path}/string_bodies")
    _short_texts(p, rules).write.mode("overwrite").parquet(f"{path}/texts")
    return load_sampled(p.spark, path)


_BODY = "owner bigint, start bigint, size bigint, kids array<struct<pos: int, child: bigint, lvl: int, one: bigint, run: bigint>>"


def load_sampled(spark: SparkSession, path: str) -> Sampled:
    rules = spark.read.schema(f"{_BODY}, lvl int").parquet(f"{path}/rule_bodies")
    heights = [r["lvl"] for r in rules.select("lvl").distinct().collect()]  # a row for each level
    return Sampled(spark.read.schema(_BODY).parquet(f"{path}/string_bodies"), rules, spark.read.schema("sym_id bigint, text binary").parquet(f"{path}/texts"), sorted(heights, reverse=True))


# ---- the way down


def _covered(met: DataFrame) -> DataFrame:
    """(qid, lo, hi, out) with a chunk each to the children that the ranges meet: (qid, sym, lvl, one, lo, hi, out).

    A short child stands once for all its copies, and its range counts over all of them; of a longer one each copy is a node.
    """
    placed = F.transform("kids", lambda k, i: F.struct(k.alias("k"), (F.col("start") + F.aggregate(F.slice("kids", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["one"] * x["run"])).alias("at")))
    kids = met.select("qid", "lo", "hi", "out", F.explode(placed).alias("x")).select("qid", "lo", "hi", "out", "x.at", "x.k.*").where("at <= hi and at + one * run > lo")
    inside = kids.select("qid", F.col("child").alias("sym"), "lvl", "one", F.expr("greatest(lo - at, 0)").alias("a"), F.expr("least(hi - at, one * run - 1)").alias("b"), F.expr("out + greatest(at - lo, 0)").alias("o"))
    copies = F.expr(f"if(one <= {SHORT}, array(0L), sequence(a div one, b div one))")
    each = inside.select("*", F.explode(copies).alias("c"))
    return each.selectExpr("qid", "sym", "lvl", "one", "greatest(a - c * one, 0L) as lo", f"if(one <= {SHORT}, b, least(b - c * one, one - 1)) as hi", "o + greatest(c * one - a, 0L) as out")


def _pieces(s: Sampled, first: DataFrame) -> DataFrame:
    """(qid, out, text): the short symbols below the first nodes, with what is covered of their texts."""
    made, levels = [], set()

    def add(nodes: DataFrame) -> None:
        # todo: the level whose rules lead on, 0 for what is short
        made.append(materialize(nodes.withColumn("todo", F.expr(f"if(one <= {SHORT}, 0, lvl)")), "nodes", by="todo"))
        levels.update(r["todo"] for r in made[-1].select("todo").distinct().collect())

    def of_all(level: int) -> DataFrame:
        parts = [m.where(F.col("todo") == level) for m in made]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    add(first)
    for lvl in s.heights:
        if lvl in levels:
            bodies = s.rules.where(F.col("lvl") == lvl).drop("lvl")
            add(_covered(of_all(lvl).join(bodies, F.expr("sym = owner and start <= hi and start + size > lo"))))
    leaves = of_all(0).join(s.texts.withColumnRenamed("sym_id", "id"), F.col("sym") == F.col("id"))
    whole = "repeat(cast(text as string), cast(hi div one - lo div one + 1 as int))"
    return leaves.select("qid", "out", F.expr(f"substring(cast({whole} as binary), cast(lo % one + 1 as int), cast(hi - lo + 1 as int))").alias("text"))


def _joined(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("qid").agg(joined_text(F.collect_list(F.struct("out", "text"))).alias("bytes"))


def access(s: Sampled, queries: DataFrame) -> DataFrame:
    """(qid, str_id, start, stop) to (qid, hex): the bytes of the ranges."""
    q = queries.where("start >= 0 and stop >= start").selectExpr("qid", "str_id", "start as lo", "stop as hi", "0L as out")
    first = _covered(q.join(s.strings, F.expr("str_id = owner and start <= hi and start + size > lo")))
    return _joined(_pieces(s, first)).select("qid", F.hex("bytes").alias("hex"))


def expand(s: Sampled) -> DataFrame:
    """(str_id, bytes) of every string that has bytes."""
    first = _covered(s.strings.selectExpr("owner as qid", "0L as lo", f"{1 << 62}L as hi", "0L as out", "start", "kids"))
    return _joined(_pieces(s, first)).withColumnRenamed("qid", "str_id")
