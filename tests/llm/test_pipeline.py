"""The stages on the smallest tables and on a fixture with every edge case."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from gramloom.llm import decontaminate, jaccard, langid, pii
from test_jaccard import _classes

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path):
    word = lambda s, i: " ".join(f"{s}{j * 7 % (11 + i)}ab" for j in range(60))
    texts = {"en": ["the house and the tree stand near the water " * 4 + word("th", i) for i in range(12)], "fr": ["la maison est près de l'eau où les arbres sont grands " * 4 + word("é", i) for i in range(12)]}
    rows = [(20 * k + i, t, lang, f"s{i % 2}", len(t), "x") for k, (lang, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows += [(90, f"{texts['en'][0]} {item} tail", "en", "s0", 1, "x"), (91, "123 456", "en", None, 7, "x"), (92, None, None, None, None, None), (93, "call +1 (368) 555-0098 " + word("zz", 9), "en", "s1", 1, "x"),
             (94, rows[0][1], "en", "s1", 1, "x"), rows[1], (None, texts["fr"][3] + " nul", "fr", "s0", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = dict(pipe.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "decontamination", "pii_pseudonyms", "source_mixing"]
    one = steps["language_id"](spark, docs, tables)
    assert one.columns == docs.columns and {91, 92}.isdisjoint(r.doc_id for r in one.collect()) and one.count() == docs.count() - 2
    two = steps["near_dedup"](spark, one, tables)
    sets = {r.doc_id: set(jaccard.shingles((r.text or "").encode()).tolist()) for r in one.collect()}
    kept = [r.doc_id for r in two.collect()]
    assert two.columns == docs.columns and len(kept) == len(set(kept)) and 94 not in kept
    near = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    assert not any(near(a, b) for a in kept for b in kept if a != b)
    assert all(any(near(a, b) for b in sets if b != a) for a in sets if a not in kept)
    three = steps["decontamination"](spark, two, tables)
    assert 90 not in [r.doc_id for r in three.collect()] and three.count() >= two.count() - 1
    four = steps["pii_pseudonyms"](spark, three, tables)
    text = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and "555-0098" not in text[93].text and text[93].n_chars == len(text[93].text)
    five = steps["source_mixing"](spark, four, tables)
    assert five.count() == four.count()
    assert sorted(map(str, pipe.run(spark, tables).collect())) == sorted(map(str, five.collect()))


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_table(spark):
    """Each decision, checked by its own operator on what came before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = pipe.language_id(spark, docs, SF)
    model = langid.fit(langid.training_rows(docs))
    assert one.count() == langid.predict(docs, model, keep=["doc_id"]).where("not rejected").count()
    assert one.count() >= 0.99 * docs.count()
    two = pipe.near_dedup(spark, one, SF)
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    assert sorted(r.doc_id for r in two.collect()) == sorted({rows[i][0] for i in _classes([t for _, t in rows])})
    three = pipe.decontamination(spark, two, SF)
    hit = decontaminate.op3_benchmark_decontamination(spark, two, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert three.count() == hit.where("not contaminated").count() and hit.where("contaminated").count() > 0
    four = pipe.pii_pseudonyms(spark, three, SF)
    assert four.join(three.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before").count() == pii.op10_pii_pseudonyms(spark, three).where("n_pii > 0").count()
