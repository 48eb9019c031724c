"""The driver's queries over whole tables: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions import metrics as M
from gramloom.operators import access as A
from gramloom.operators import derive as D
from gramloom.operators import edit as E
from gramloom.operators import grammar as G
from gramloom.operators import merge as X
from gramloom.operators import parse as P
from gramloom.plans.materialize import fresh_path, materialize, with_running_sum
from gramloom.sources import storage
from gramloom.sources import strings as S
from gramloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main collection of the queries: texts in order of conversation and turn."""
    return S.from_table(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_table(table(spark, sf_dir, "documents"), "doc_id")


def _spelled(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def _on_strings(f: Callable[[DataFrame], DataFrame], of: Query = conversations) -> Query:
    return lambda spark, sf_dir: f(of(spark, sf_dir))


def _on_grammar(f: Callable[[G.Grammar], DataFrame]) -> Query:
    return _on_strings(lambda s: f(G.build(s)))


def _on_plain(f: Callable[[G.Packed], DataFrame]) -> Query:
    return _on_grammar(lambda g: f(G.pack(g)))


def _on_rl(f: Callable[[G.Packed], DataFrame]) -> Query:
    return _on_plain(lambda p: f(G.run_length(p)))


def _on_simple(f: Callable[[G.Packed], DataFrame]) -> Query:
    return _on_rl(lambda p: f(G.simplify(p)))


def _on_halves(f: Callable[[G.Grammar, G.Grammar], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = materialize(conversations(spark, sf_dir), "strings")
        return f(G.build(s.where("str_id % 2 = 0")), G.build(s.where("str_id % 2 = 1")))

    return query


def _levels(rules: DataFrame) -> DataFrame:
    return rules.groupBy("lvl").agg(F.count("*").alias("n_rules"), F.sum(G.n_children(F.col("rhs"))).alias("n_symbols"))


def _level_by_range(p: G.Packed) -> DataFrame:
    """Levels from the first id of each level: a join of each symbol with the level whose ids hold its own."""
    first = p.sym.groupBy("lvl").agg(F.min("sym_id").alias("low"), F.max("sym_id").alias("high"))  # a row for each level
    return p.sym.select("sym_id").join(F.broadcast(first), F.col("sym_id").between(F.col("low"), F.col("high"))).select("sym_id", "lvl")


def _ends(p: G.Packed) -> DataFrame:
    kids = p.rhs.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("pos", "child"))).alias("x")).select(F.col("owner").alias("sym_id"), F.transform("x", lambda k: k["child"]).alias("k"))
    return kids.select("sym_id", F.slice("k", 1, 2).alias("prefix"), F.reverse(F.slice("k", F.greatest(F.size("k") - 1, F.lit(1)), F.lit(2))).alias("suffix"))


def _unrolled(p: G.Packed) -> DataFrame:
    rl = p.rl.select(F.col("sym_id").alias("id"), F.col("child").alias("one"), "run_len")
    rows = p.rhs.join(rl, F.col("child") == F.col("id"), "left").select("owner", F.struct("pos", F.coalesce("one", "child").alias("child"), F.coalesce("run_len", F.lit(1)).alias("n")).alias("x"))
    whole = rows.groupBy("owner").agg(F.sort_array(F.collect_list("x")).alias("x")).select("owner", F.flatten(F.transform("x", lambda k: F.array_repeat(k["child"], k["n"].cast("int")))).alias("kids"))
    return whole.select("owner", F.posexplode("kids").alias("pos", "child"))


def _coordinates(s: DataFrame) -> DataFrame:
    """For each string a range: from a quarter of its bytes on, 10 to 49 bytes."""
    a = F.floor(F.octet_length("text") / 4).cast("bigint")
    return s.select(F.col("str_id").alias("qid"), "str_id", a.alias("start"), (a + 9 + F.col("str_id") % 40).alias("stop"))


def _access(simple: bool, char: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = conversations(spark, sf_dir)
        q = _coordinates(s)
        p = G.run_length(G.pack(G.build(s)))
        path = fresh_path(spark, "stored")
        storage.save_packed(G.simplify(p) if simple else p, path, simplified=simple, random_access=True)
        return A.access(storage.load_samples(spark, path), q.withColumn("stop", F.col("start")) if char else q)

    return query


def _parse_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coordinates(conversations(spark, sf_dir))
    text = F.when(F.col("qid") % 7 == 3, F.concat_ws(":", "qid", "start")).when(F.col("qid") % 7 == 5, F.concat(F.lit("x:"), "start", F.lit("-"), "stop")).otherwise(F.concat(F.col("qid"), F.lit(":"), F.col("start"), F.lit("-"), F.col("stop")))
    return S.coordinates(c.select(text.alias("query")))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("bigint") * F.col("o_custkey")).alias("v"))
    edge = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 2, 127, 128, 255, 256, 16383, 16384, 1073741824)])).alias("v"))
    return own.union(edge).distinct()


def _bit_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _values(spark, sf_dir).select(
        "v", M.bit_width(v).alias("width"), M.next_power_of_two(v).alias("next_power"), M.prev_power_of_two(v).alias("prev_power"), M.is_power_of_two(v).alias("is_power"), M.round_to_power_of_two(v).alias("rounded"))


def _vbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    coded = _values(spark, sf_dir).select("v", M.vbyte_len(v).alias("n_bytes"), M.vbyte_encode(v).alias("forward"), M.vbyte_encode(v, backward=True).alias("backward"))
    return coded.select("*", M.vbyte_decode(F.col("forward")).alias("decoded"), M.vbyte_decode(F.col("backward")).alias("decoded_back"))


def _report_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("bigint") * 977 % 90000000).alias("v")).distinct()
    return v.select("v", M.report_speed(F.col("v"), F.lit(250_000)).alias("speed"), M.report_time(F.col("v")).alias("elapsed"))


def _ranges(s: DataFrame) -> DataFrame:
    """From every string the bytes from a quarter to the half."""
    n = F.octet_length("text")
    return s.select("str_id", F.floor(n / 4).cast("bigint").alias("start"), F.floor(n / 2).cast("bigint").alias("stop"))


def _delete(spark: SparkSession, sf_dir: str) -> E.Edited:
    s = materialize(conversations(spark, sf_dir), "strings")
    return E.delete_ranges(G.build(s), s, _ranges(s))


#: Bytes of text in a file that the stream reads.
FILE_BYTES = 1 << 25


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches, each of as many files as a third of the texts fills."""
    path, s = fresh_path(spark, "incremental"), conversations(spark, sf_dir)
    n_bytes = s.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_once = 1 + n_bytes // (3 * FILE_BYTES)
    s.repartition(3 * at_once, "str_id").write.parquet(f"{path}/source")
    incremental.build_stream(spark, f"{path}/source", "str_id bigint, text string", path, files_at_once=at_once)
    return _levels(incremental.load_state(spark, path).rules)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stored")
    p = G.simplify(G.run_length(G.pack(G.build(conversations(spark, sf_dir)))))
    storage.save_packed(p, path, simplified=True, random_access=False)
    return storage.metadata(spark, path)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stored")
    storage.save(G.build(conversations(spark, sf_dir)), path)
    return _levels(storage.load(spark, path).rules)


def _merged(a: G.Grammar, b: G.Grammar) -> DataFrame:
    """Both are stored and read back before they are merged."""
    spark, back = a.rules.sparkSession, []
    for g in (a, b):
        path = fresh_path(spark, "half")
        storage.save(g, path)
        back.append(storage.load(spark, path))
    return G.merge(*back).rules.select("lvl", _spelled("fp"), _spelled("rhs"))


def _lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = materialize(D.decompress(A.sample(G.pack(G.build(conversations(spark, sf_dir))))), "texts")
    pairs = t.select(F.col("str_id").alias("a")).join(t.select((F.col("str_id") - 2).alias("a")), "a").select("a", (F.col("a") + 2).alias("b"))
    return D.lcp(pairs, t)


def _round(level: int) -> Query:
    return _on_strings(lambda s: P.parse_rows(s, least=level, most=level).select("str_id", "pos", _spelled("fp"), "start", "size"))


def _boundaries(p: G.Packed) -> DataFrame:
    sized = p.roots.groupBy("str_id").agg(F.count("*").alias("size"))
    return with_running_sum(sized, ["str_id"], "size", "start").select("str_id", "start", "size")


QUERIES: dict[str, Query] = {
    "scan_strings": _on_strings(lambda s: s.select("str_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))),
    "collection_stats": _on_strings(S.profile),
    "byte_histogram": _on_strings(P.byte_counts, documents),
    "string_offsets": _on_strings(S.offsets),
    "byte_fingerprints": lambda spark, sf_dir: G.terminals(spark).select("byte", _spelled("fp")),
    "symbol_runs": _on_strings(P.run_rows),
    "parse_round1": _round(1),
    "parse_round2": _round(2),
    "parse_all_levels": _on_strings(lambda s: P.parse_rows(s).select("str_id", "lvl", "pos", _spelled("fp"))),
    "level_rules": _on_grammar(lambda g: g.rules.select("lvl", _spelled("fp"), _spelled("rhs"))),
    "rules_per_level": _on_grammar(lambda g: _levels(g.rules)),
    "string_heights": _on_grammar(lambda g: g.strings.where("fp is not null").select("str_id", F.col("lvl").alias("height"), _spelled("fp"))),
    "phrase_counts": _on_strings(lambda s: P.parse_rows(s).groupBy("lvl", "fp").agg(F.count("*").alias("n")).select("lvl", _spelled("fp"), "n")),
    "assign_ids": _on_plain(lambda p: p.sym.select("sym_id", "kind", "lvl", _spelled("fp"))),
    "symbol_freq": _on_plain(lambda p: G.frequencies(p).select("sym_id", "freq")),
    "symbol_kinds": _on_rl(lambda p: p.sym.groupBy("kind").agg(F.count("*").alias("n"))),
    "symbol_level": _on_plain(_level_by_range),
    "rule_lengths": _on_plain(lambda p: p.rhs.groupBy(F.col("owner").alias("sym_id")).agg(F.count("*").alias("n_children"))),
    "rhs_ends": _on_plain(_ends),
    "grammar_stats": _on_plain(G.size_row),
    "strings_in_order": _on_plain(lambda p: p.roots.select("str_id", F.col("child").alias("sym_id")).orderBy("str_id")),
    "expansion_length": _on_rl(lambda p: p.sym.select("sym_id", "len")),
    "expand_symbol": _on_plain(D.expansions),
    "decompress": _on_simple(lambda p: D.decompress(A.sample(p))),
    "verify_roundtrip": lambda spark, sf_dir: D.verify(A.sample(G.run_length(G.pack(G.build(conversations(spark, sf_dir))))), conversations(spark, sf_dir)),
    "parse_tree": _on_plain(D.parse_tree),
    "ra_samples_rules": _on_rl(A.rule_samples),
    "ra_samples_strings": _on_simple(A.string_samples),
    "access_char": _access(simple=False, char=True),
    "access_range": _access(simple=True, char=False),
    "parse_coords": _parse_coords,
    "rl_runs": _on_plain(lambda p: G.runs(p.rhs).where("run_len > 1").select("owner", "pos", "child", "run_len")),
    "rl_rules": _on_rl(lambda p: p.rl),
    "rl_rewrite": _on_rl(lambda p: p.rhs.select("owner", "pos", "child")),
    "rhs_unrolled": _on_rl(_unrolled),
    "disposable_symbols": _on_rl(G.disposable),
    "id_compaction": _on_rl(G.compaction),
    "simplified_rules": _on_simple(lambda p: p.rhs.select("owner", "pos", "child")),
    "simplified_stats": _on_simple(G.size_row),
    "string_rhs_len": _on_simple(lambda p: p.roots.groupBy("str_id").agg(F.count("*").alias("n"))),
    "string_boundaries": _on_simple(_boundaries),
    "alphabet_remap": _on_simple(lambda p: p.sym.where("kind = 't'").select(F.col("sym_id").alias("new_id"), "byte")),
    "known_rules": _on_halves(lambda a, b: X.known_rules(a, b).select("lvl", _spelled("fp"))),
    "new_rules": _on_halves(lambda a, b: X.new_rules(a, b).select("lvl", _spelled("fp"))),
    "merge_marks": _on_halves(lambda a, b: X.marks(a, b).groupBy("lvl", "mark").agg(F.count("*").alias("n"))),
    "merge_grammars": _on_halves(_merged),
    "merge_strings": _on_halves(lambda a, b: G.merge(a, b).strings.where("fp is not null").select("str_id", "lvl", _spelled("fp"))),
    "incremental_build": _incremental,
    "fp_placement": _on_halves(lambda a, b: X.placement(a, b).select("lvl", _spelled("fp"), "place")),
    "bit_widths": _bit_widths,
    "vbyte_size": _on_strings(lambda s: P.parse_rows(s).groupBy("lvl", "fp").agg(F.count("*").alias("n")).groupBy("lvl").agg(F.sum(M.vbyte_len(F.col("n"))).alias("n_bytes"))),
    "vbyte_roundtrip": _vbyte_roundtrip,
    "h0_entropy": _on_rl(lambda p: M.entropy(G.frequencies(p))),
    "code_sizes": _on_rl(lambda p: M.code_sizes(G.frequencies(p))),
    "report_space": lambda spark, sf_dir: _values(spark, sf_dir).select("v", M.report_space(F.col("v")).alias("space")),
    "report_rates": _report_rates,
    "delete_range": lambda spark, sf_dir: _delete(spark, sf_dir).changed.where("fp is not null").select("str_id", "lvl", _spelled("fp")),
    "delete_range_stats": lambda spark, sf_dir: _levels(_delete(spark, sf_dir).grammar.rules),
    "lcp_pairs": _lcp,
    "grammar_meta": _meta,
    "stored_rules": _stored,
}
