"""The whole build: parse, pack, run-length rules, simplification, storage, verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators import access, derive, grammar
from gramloom.plans.materialize import materialize
from gramloom.sources import storage, strings


@dataclass(frozen=True)
class Options:
    """What a build does beside parsing: run-length rules, simplification, samples for random access, a check that
    the grammar spells the input; bytes of an input split."""

    run_length: bool = True
    simplify: bool = True
    random_access: bool = False
    verify: bool = False
    split_bytes: int | None = None


def finish(g: grammar.Grammar, collection: DataFrame | None, options: Options) -> grammar.Packed:
    """A built grammar, packed as the options say; verified against the collection it was built from."""
    p = grammar.pack(g)
    if options.run_length:
        p = grammar.run_length(p)
    if options.simplify:
        p = grammar.simplify(p)
    if options.verify and collection is not None:
        row = derive.verify(access.sample(p), collection).first()
        if row["n_strings"] != row["n_equal"]:
            raise ValueError(f"{row['n_strings'] - row['n_equal']} strings differ from what the grammar spells")
    return p


def compress(collection: DataFrame, options: Options = Options()) -> grammar.Packed:
    """The packed grammar of (str_id, text)."""
    return finish(grammar.build(collection), collection, options)


def _store(g: grammar.Grammar, collection: DataFrame | None, output: str, options: Options) -> None:
    storage.save(g, f"{output}/content")
    storage.save_packed(finish(g, collection, options), output, simplified=options.simplify, random_access=options.random_access)


def compress_file(spark: SparkSession, text: str, output: str, options: Options = Options()) -> None:
    """A text file, one string a line, to a stored grammar: the dense form, and the content-addressed one to merge by."""
    collection = strings.from_text(spark, text, split_bytes=options.split_bytes)
    _store(grammar.build(collection), collection, output, options)


def merge_files(spark: SparkSession, stored: list[str], output: str, options: Options = Options()) -> None:
    """Stored grammars to one, that can be merged again; strings are numbered on in the order given."""
    whole, first = None, 0
    for path in stored:
        g = storage.load(spark, f"{path}/content")
        g = grammar.Grammar(g.rules, g.strings.withColumn("str_id", F.col("str_id") + first))
        whole = g if whole is None else grammar.merge(whole, g)
        first = (g.strings.agg(F.max("str_id")).first()[0] or 0) + 1
    _store(grammar.Grammar(materialize(whole.rules, "merged"), whole.strings), None, output, options)


def query_file(spark: SparkSession, stored: str, coordinates: list[str]) -> DataFrame:
    """(query, hex) for "STR:START-END" coordinates on a grammar stored with random access; bad ones raise an error."""
    given = spark.createDataFrame([(c,) for c in coordinates], "query string")
    parsed = strings.coordinates(given)
    bad = parsed.where("str_id is null or stop < start").first()
    if bad is not None:
        raise ValueError(f"not STR:START-END: {bad['query']}")
    q = parsed.select(parsed["query"].alias("qid"), "str_id", "start", "stop")
    return access.access(storage.load_samples(spark, stored), q).withColumnRenamed("qid", "query")
