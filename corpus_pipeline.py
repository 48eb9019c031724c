"""A corpus pipeline of five stages over `documents`: each takes (spark, docs, sf_dir) and returns
what the next one gets. All but the last return the columns of their input.

Rows are told apart by their id and the hash of their text, so null ids and ids that occur twice
are rows like any other; columns beside the ones used are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import decontaminate, jaccard, langid, mixing, pii
from gramloom.llm.common import load, table


def _key(docs: DataFrame):
    return F.struct(docs["doc_id"].alias("i"), F.xxhash64(docs["text"]).alias("h"))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose key is among the keys (i, h), or isn't."""
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["i"]) & (F.xxhash64(docs["text"]) == keys["h"]), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their own labels, doesn't reject."""
    model = langid.fit(langid.training_rows(docs))
    marked = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")
    found = langid.predict(marked.withColumnRenamed(f"c{at}", "text"), model, keep=[f"c{i}" if i != at else "text" for i in range(len(docs.columns))])
    return found.where("not rejected").drop("lang_pred", "score", "rejected").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates: similarity of five-word shingles of 0.8 or more,
    linked by SimHash and, where that misses a pair, by prefix filtering. Of rows with equal id and text the one whose
    other columns come first (as JSON) stays."""
    classes = table(jaccard.classes(docs.select(_key(docs).alias("id"), "text")), "classes")
    kept = _joined(docs, classes.select("component_id.*").distinct(), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest or classes.groupBy("id").count().where("count > 1").isEmpty():
        return kept if rest else kept.dropDuplicates()
    others = F.struct(*rest)
    one = kept.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others, {"ignoreNullFields": "false"})).alias("others"))
    return one.select("doc_id", "text", "others.*").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    hits = decontaminate.find_hits(docs.select(_key(docs).alias("doc_id"), "text"), load(spark, sf_dir, "benchmark"))
    return _joined(docs, hits.where(F.size("hits") > 0).select("doc_id.*").distinct(), "left_anti")


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms, and their n_chars with them."""
    masked = pii.pseudonymise(docs)
    masked = masked.drop(masked.columns[-1])
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.op6_source_mixing(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("source_mixing", source_mixing),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
