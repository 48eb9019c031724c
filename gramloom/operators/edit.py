"""Deleting ranges: the strings that change are parsed anew, the rules of the others stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators.grammar import Grammar, build, children
from gramloom.plans.materialize import materialize


def cut_ranges(strings: DataFrame, ranges: DataFrame) -> DataFrame:
    """(str_id, text: binary) of the strings that ranges (str_id, start, stop; stop included) touch, without the
    ranges' bytes. Ranges may overlap and reach beyond the end."""
    per = ranges.where("stop >= start and start >= 0").groupBy("str_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("rs"))
    data = strings.select("str_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"))
    # what stands between the end of the ranges so far and the next one's start
    expr = "aggregate(rs, named_struct('at', cast(0 as bigint), 'kept', cast(array() as array<string>)), (s, r) -> named_struct('at', greatest(s.at, r.stop + 1), 'kept', concat(s.kept, array(hex(substring(b, cast(s.at + 1 as int), cast(greatest(r.start - s.at, 0) as int)))))), s -> unhex(concat(array_join(s.kept, ''), hex(substring(b, cast(s.at + 1 as int), greatest(length(b) - cast(s.at as int), 0))))))"
    return data.join(per, "str_id").select("str_id", F.expr(expr).alias("text"))


@dataclass(frozen=True)
class Edited:
    grammar: Grammar
    #: (str_id, lvl, fp, len) of the strings that were parsed anew.
    changed: DataFrame


def delete_ranges(g: Grammar, strings: DataFrame, ranges: DataFrame) -> Edited:
    """The grammar of the edited collection. Rules of unchanged strings are kept, those of changed ones are
    built; rules that nothing uses any more go (reached from the strings, level by level)."""
    edited = materialize(cut_ranges(strings, ranges), "edited")
    fresh = build(edited)
    kept = g.strings.join(edited.select("str_id"), "str_id", "left_anti")
    strings_now = materialize(kept.unionByName(fresh.strings), "strings")
    return Edited(Grammar(reachable(g.rules.unionByName(fresh.rules).distinct(), strings_now), strings_now), fresh.strings)


def reachable(rules: DataFrame, strings: DataFrame) -> DataFrame:
    """The rules that strings use, from the top level down: a join for each level."""
    rules = materialize(rules, "union")
    top = rules.agg(F.max("lvl")).first()[0] or 0
    out, wanted = None, strings.where("fp is not null").select("lvl", "fp").distinct()
    for lvl in range(top, 0, -1):
        here = materialize(rules.where(F.col("lvl") == lvl).join(wanted.where(F.col("lvl") == lvl).select("fp").distinct(), "fp", "left_semi").select(rules.columns), "reached")
        out = here if out is None else out.unionByName(here)
        below = here.select(F.lit(lvl - 1).alias("lvl"), F.explode(children(F.col("rhs"))).alias("fp"))
        wanted = strings.where("fp is not null").where(F.col("lvl") == lvl - 1).select("lvl", "fp").unionByName(below).distinct()
    return out if out is not None else rules
