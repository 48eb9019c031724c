"""Grammars as tables: distinct rules, dense ids, run-length rules, simplification.

A built grammar is content-addressed: `rules` (lvl, fp, rhs, len) and `strings` (str_id, lvl, fp,
len), where fp is a fingerprint of 16 bytes, rhs the children's fingerprints one after the other
and len the bytes of the expansion. Building in parallel, merging and incremental building are
all the same: union and distinct. Packing gives dense ids: terminals 0 to 255, rules by (lvl, fp)
from 256, run-length rules by (child, length) after them, the start symbol last.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.operators.parse import build_rows
from gramloom.plans.materialize import materialize, with_row_index

N_TERMINALS = 256


@dataclass(frozen=True)
class Grammar:
    """rules (lvl, fp, rhs, len); strings (str_id, lvl, fp, len); null fp for strings without bytes."""

    rules: DataFrame
    strings: DataFrame


def build(strings: DataFrame, *, spread: int | None = None) -> Grammar:
    """The grammar of (str_id, text). Texts are parsed once, and what is parsed is written once: the one large
    shuffle is the distinct of the rules, which every task has done for its batches before. The strings' rows
    pass through it, one each. `spread` deals the strings over so many tasks first, for input that lies in
    fewer row groups than there are cores."""
    strings = strings.repartition(spread) if spread else strings
    rows = materialize(build_rows(strings).distinct(), "built")
    return Grammar(rows.where("rhs is not null").select("lvl", "fp", "rhs", "len"), rows.where("rhs is null").select("str_id", "lvl", "fp", "len"))


def merge(a: Grammar, b: Grammar) -> Grammar:
    """Union of two grammars; string ids must not meet."""
    return Grammar(a.rules.unionByName(b.rules).distinct(), a.strings.unionByName(b.strings))


def collisions(g: Grammar) -> DataFrame:
    """(lvl, fp) with more than one body: none, unless MD5 collides."""
    return g.rules.groupBy("lvl", "fp").count().where("count > 1")


def children(rhs: Column) -> Column:
    """array<binary>: the fingerprints of a body."""
    n = (F.octet_length(rhs) / 16).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(rhs, i * 16 + 1, F.lit(16)))


def n_children(rhs: Column) -> Column:
    return (F.octet_length(rhs) / 16).cast("bigint")


def terminals(spark: SparkSession) -> DataFrame:
    """(sym_id, kind, lvl, fp, byte, len) of the 256 terminals."""
    hexed = F.lpad(F.hex("id"), 2, "0")
    return spark.range(N_TERMINALS).select(
        F.col("id").alias("sym_id"), F.lit("t").alias("kind"), F.lit(0).alias("lvl"), F.unhex(F.md5(hexed.cast("binary"))).alias("fp"), F.col("id").cast("int").alias("byte"), F.lit(1).cast("bigint").alias("len"))


@dataclass(frozen=True)
class Packed:
    """sym (sym_id, kind, lvl, fp, byte, len): kinds t (terminal), lc (rule), rl (run-length rule).
    rhs (owner, pos, child, len) of the rules; roots (str_id, pos, child, len) of the strings; len: bytes of
    the child's expansion; once run-length rules are made, start: its first byte in the owner's; rl (sym_id, child, run_len). n_rules, n_rl: how many of each; n_strings: with bytes; n: bytes and a separator each."""

    sym: DataFrame
    rhs: DataFrame
    roots: DataFrame
    rl: DataFrame
    n_rules: int
    n_rl: int
    n_strings: int
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.sym.sparkSession


def pack(g: Grammar) -> Packed:
    """Dense ids, and bodies by id."""
    spark = g.rules.sparkSession
    numbered = with_row_index(g.rules, ["lvl", "fp"], "nth").select((F.col("nth") + N_TERMINALS).alias("sym_id"), "lvl", "fp", "rhs", "len")
    sym = terminals(spark).unionByName(numbered.select("sym_id", F.lit("lc").alias("kind"), "lvl", "fp", F.lit(None).cast("int").alias("byte"), "len"))
    # a number first among the join's keys: rows are then sorted by it, and binaries compared only where it is equal
    used = sym.select(F.col("sym_id").alias("child"), F.col("lvl").alias("l"), F.col("fp").alias("f"), "len", F.xxhash64("lvl", "fp").alias("j"))
    same = (F.col("k") == F.col("j")) & (F.col("fp") == F.col("f")) & (F.col("below") == F.col("l"))
    parts = numbered.select(F.col("sym_id").alias("owner"), (F.col("lvl") - 1).alias("below"), F.posexplode(children(F.col("rhs"))).alias("pos", "fp")).withColumn("k", F.xxhash64("below", "fp"))
    rhs = materialize(parts.join(used, same).select("owner", "pos", "child", "len"), "rhs")
    roots = g.strings.where("fp is not null").select("str_id", F.col("lvl").alias("below"), "fp").withColumn("k", F.xxhash64("below", "fp")).join(used, same)
    roots = materialize(roots.select("str_id", F.lit(0).alias("pos"), "child", "len"), "roots")
    counts = g.strings.agg(F.count("fp").alias("s"), F.coalesce(F.sum(F.when(F.col("fp").isNotNull(), F.col("len") + 1)), F.lit(0)).alias("n")).first()
    none = spark.range(0).select(F.col("id").alias("sym_id"), F.col("id").alias("child"), F.col("id").alias("run_len"))  # a list of rows would start Python workers
    return Packed(sym, rhs, roots, none, numbered.count(), 0, counts["s"], counts["n"])


# ---- run-length rules


def runs(rhs: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, pos, child, run_len, len, nth, start): the maximal runs of equal children, by where they begin; len of all
    of it, nth its number in the owner, start its first byte."""
    w = Window.partitionBy(owner).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("child") == F.lag("child").over(w), 0).otherwise(1)
    numbered = rhs.select(owner, "pos", "child", "len").withColumn("new", new).withColumn("start", F.sum("len").over(upto) - F.col("len")).withColumn("run", F.sum("new").over(upto))
    return numbered.groupBy(owner, "run", "child").agg(F.min("pos").alias("pos"), F.count("*").alias("run_len"), F.sum("len").alias("len"), F.min("start").alias("start")).withColumn("nth", (F.col("run") - 1).cast("int")).drop("run")


def run_length(p: Packed) -> Packed:
    """Every maximal run of more than one symbol in a body becomes one symbol, a rule for each (child, length).
    Only those runs are joined with the rules; the others stay as they are."""
    all_runs, string_runs = materialize(runs(p.rhs), "runs"), materialize(runs(p.roots, "str_id"), "runs")
    long_ = all_runs.where("run_len > 1").select("child", "run_len").union(string_runs.where("run_len > 1").select("child", "run_len")).distinct()
    first = N_TERMINALS + p.n_rules
    rl = materialize(with_row_index(long_, ["child", "run_len"], "nth").select((F.col("nth") + first).alias("sym_id"), "child", "run_len"), "rl")
    by = rl.select(F.col("sym_id").alias("rl_id"), F.col("child").alias("c"), F.col("run_len").alias("l"))

    def rewritten(r: DataFrame, owner: str) -> DataFrame:
        joined = r.where("run_len > 1").join(by, (F.col("child") == F.col("c")) & (F.col("run_len") == F.col("l")))
        made = materialize(joined.select(owner, F.col("nth").alias("pos"), F.col("rl_id").alias("child"), "len", "start"), "long_runs")
        return r.where("run_len = 1").select(owner, F.col("nth").alias("pos"), "child", "len", "start").unionByName(made)

    rhs, roots = rewritten(all_runs, "owner"), rewritten(string_runs, "str_id")
    of = p.sym.select(F.col("sym_id").alias("c"), "lvl", F.col("len").alias("one"))
    as_sym = rl.join(of, F.col("child") == F.col("c")).select(
        "sym_id", F.lit("rl").alias("kind"), "lvl", F.lit(None).cast("binary").alias("fp"), F.lit(None).cast("int").alias("byte"), (F.col("one") * F.col("run_len")).alias("len"))
    return replace(p, sym=materialize(p.sym.unionByName(as_sym), "sym"), rhs=rhs, roots=roots, rl=rl, n_rl=rl.count())


# ---- use of symbols, simplification


def frequencies(p: Packed) -> DataFrame:
    """(sym_id, freq): occurrences in bodies and strings; the body of a run-length rule counts as two."""
    used = p.rhs.select("child", F.lit(1).alias("k")).union(p.roots.select("child", F.lit(1))).union(p.rl.select("child", F.lit(2)))
    n = used.groupBy("child").agg(F.sum("k").cast("bigint").alias("freq"))
    return p.sym.select("sym_id", "kind", "lvl").join(n, F.col("sym_id") == F.col("child"), "left").select("sym_id", "kind", "lvl", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


_DISPOSABLE = "freq = 0 or freq = 1 and kind = 'lc'"


def disposable(p: Packed, freq: DataFrame | None = None) -> DataFrame:
    """(sym_id, kind, freq): terminals and rules that aren't used, rules that are used once; never run-length rules used once."""
    f = frequencies(p) if freq is None else freq
    return f.where(_DISPOSABLE).select("sym_id", "kind", "freq")


def compaction(p: Packed, freq: DataFrame | None = None) -> DataFrame:
    """(sym_id, new_id): kept symbols renumbered without gaps, in their order."""
    f = materialize(frequencies(p), "frequencies") if freq is None else freq
    return with_row_index(f.where(f"not ({_DISPOSABLE})").select("sym_id"), ["sym_id"], "new_id")


def with_starts(rhs: DataFrame, owner: str) -> DataFrame:
    """rhs with a column start: the child's first byte in its owner's expansion."""
    if "start" in rhs.columns:
        return rhs
    w = Window.partitionBy(owner).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rhs.withColumn("start", F.sum("len").over(w) - F.col("len"))


def inlined(p: Packed, freq: DataFrame, ids: DataFrame) -> DataFrame:
    """(owner, str_id, start, child, len) of kept rules (str_id null) and of strings (owner null), by new ids: every rule
    that is used once is replaced by its own body, all the way down; children are in order of start.

    A rule that is used once has one place, (owner, start). Places are followed upwards by pointer jumping: each
    round joins the places that still stand in such a rule with that rule's own, so there are as many rounds as
    the logarithm of the number of levels, and each row moves once a round. Bodies are joined twice: with the new
    ids of children, which rules used once don't have, and with where their owner stands in the end.
    """
    once = materialize(disposable(p, freq).where("freq = 1").select(F.col("sym_id").alias("once")), "once")
    in_rules, in_strings = with_starts(p.rhs, "owner"), with_starts(p.roots, "str_id")
    none = F.lit(None).cast("bigint")
    used = in_rules.select("owner", none.alias("str_id"), "start", "child", "len").unionByName(in_strings.select(none.alias("owner"), "str_id", "start", "child", "len"))
    new = ids.select(F.col("sym_id").alias("old"), F.col("new_id").alias("new_child"))
    used = materialize(used.join(new, F.col("child") == F.col("old"), "left").drop("old"), "used")
    place = used.where("new_child is null").select(F.col("child").alias("rule"), F.col("owner").alias("in_rule"), F.col("str_id").alias("in_string"), F.col("start").alias("at"))
    place = materialize(place.join(once, F.col("in_rule") == F.col("once"), "left").select("rule", "in_rule", "in_string", "at", F.col("once").isNotNull().alias("open")), "place")
    while not place.where("open").isEmpty():
        above = place.select(F.col("rule").alias("r"), F.col("in_rule").alias("up"), F.col("in_string").alias("up_string"), F.col("at").alias("up_at"), F.col("open").alias("up_open"))
        moved = place.where("open").join(above, F.col("in_rule") == F.col("r")).select("rule", F.col("up").alias("in_rule"), F.col("up_string").alias("in_string"), (F.col("at") + F.col("up_at")).alias("at"), F.col("up_open").alias("open"))
        place = materialize(place.where("not open").unionByName(moved), "place")
    # rules that nothing uses are in neither part, and what stands in them has no place: they have bodies no more
    kept = ids.select(F.col("sym_id").alias("of"), F.col("new_id").alias("to"), none.alias("in_string"), F.lit(0).cast("bigint").alias("at"))
    gone = place.join(ids, F.col("in_rule") == F.col("sym_id"), "left").select(F.col("rule").alias("of"), F.col("new_id").alias("to"), "in_string", "at").where("to is not null or in_string is not null")
    bodies = used.where("new_child is not null and owner is not null").join(kept.unionByName(gone), F.col("owner") == F.col("of"))
    bodies = bodies.select(F.col("to").alias("owner"), F.col("in_string").alias("str_id"), (F.col("start") + F.col("at")).alias("start"), F.col("new_child").alias("child"), "len")
    return bodies.unionByName(used.where("new_child is not null and str_id is not null").select("owner", "str_id", "start", F.col("new_child").alias("child"), "len"))


def simplify(p: Packed) -> Packed:
    """Without disposable symbols, and with ids that have no gaps."""
    freq = materialize(frequencies(p), "frequencies")
    ids = compaction(p, freq)
    old = ids.select(F.col("sym_id").alias("old"), "new_id")
    new = lambda df, c: df.join(old, F.col(c) == F.col("old")).drop(c, "old").withColumnRenamed("new_id", c)
    w = Window.partitionBy("owner", "str_id").orderBy("start")
    bodies = materialize(inlined(p, freq, ids).withColumn("pos", F.row_number().over(w) - 1), "bodies")
    rhs, roots = bodies.where("owner is not null").select("owner", "pos", "child", "len", "start"), bodies.where("str_id is not null").select("str_id", "pos", "child", "len", "start")
    rl = new(new(p.rl, "child"), "sym_id").select("sym_id", "child", "run_len")
    sym = materialize(new(p.sym, "sym_id").select(p.sym.columns), "sym")
    n_rules = sym.where("kind = 'lc'").count()
    return replace(p, sym=sym, rhs=rhs, roots=roots, rl=materialize(rl, "rl"), n_rules=n_rules, n_rl=sym.where("kind = 'rl'").count())


# ---- sizes


def size_row(p: Packed) -> DataFrame:
    """One row: n, r, g, c, s, n_terminals, n_lc, n_rl."""
    bits = lambda c: F.when(c == 0, 0).otherwise(F.length(F.bin(c)))
    t = p.sym.agg(F.sum(F.when(F.col("kind") == "t", 1).otherwise(0)).alias("n_terminals"), F.count("*").alias("n_sym"))
    body = p.rhs.agg(F.count("*").alias("body"))
    c = p.roots.agg(F.count("*").alias("c"))
    one = t.join(body, F.lit(True)).join(c, F.lit(True))  # each is one row of sums
    out = one.select(
        F.lit(p.n).cast("bigint").alias("n"), (F.col("n_sym") + 1).alias("r"), (F.col("n_terminals") + F.col("body") + F.col("c") + 2 * p.n_rl).alias("g"), "c", F.lit(p.n_strings).cast("bigint").alias("s"),
        F.col("n_terminals").cast("bigint").alias("n_terminals"), F.lit(p.n_rules).cast("bigint").alias("n_lc"), F.lit(p.n_rl).cast("bigint").alias("n_rl"))
    ceil8 = lambda c: F.floor((c + 7) / 8)
    space = ceil8(F.col("r") * bits(F.col("g"))) + ceil8(F.col("g") * bits(F.col("r"))) + (F.col("s") + 1) * 8
    return out.withColumn("ratio", F.round(F.col("n") / space, 4))
