"""Incremental builds: any split into batches gives the joint build."""

from pyspark.sql import functions as F

from gramloom.operators import grammar as G
from gramloom.plans import queries as Q
from gramloom.streaming import incremental as I


def test_stream(spark, tmp_path):
    rows = [(i, f"string {i % 4} of the stream, string {i % 7}") for i in range(30)] + [(30, ""), (31, None)]
    df = spark.createDataFrame(rows, "str_id long, text string")
    df.repartition(4, "str_id").write.parquet(str(tmp_path / "in"))
    I.build_stream(spark, str(tmp_path / "in"), "str_id bigint, text string", str(tmp_path / "state"))
    state, joint = I.load_state(spark, str(tmp_path / "state")), G.build(df)
    assert state.rules.count() == joint.rules.count()
    assert state.rules.select("lvl", "fp").exceptAll(joint.rules.select("lvl", "fp")).isEmpty()
    assert state.strings.count() == 32

    # more files later: only new rules are added
    spark.createDataFrame([(40, "string 1 of the stream, string 1"), (41, "something else")], "str_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    I.build_stream(spark, str(tmp_path / "in"), "str_id bigint, text string", str(tmp_path / "state"))
    again = I.load_state(spark, str(tmp_path / "state"))
    assert again.strings.count() == 34 and again.rules.groupBy("lvl", "fp").count().where("count > 1").isEmpty()


def test_batch_again(spark, tmp_path):
    df = spark.createDataFrame([(0, "once and once more")], "str_id long, text string")
    for _ in range(2):
        I.add_batch(df, 0, str(tmp_path))
    assert I.load_state(spark, str(tmp_path)).rules.count() == G.build(df).rules.count()
    I.add_batch(df.withColumn("str_id", F.lit(1).cast("bigint")), 1, str(tmp_path))
    assert I.load_state(spark, str(tmp_path)).rules.count() == G.build(df).rules.count()


def test_a_batch_in_one_partition_is_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    tasks, build_rows = [], I.build_rows
    monkeypatch.setattr(I, "build_rows", lambda s: (tasks.append(s.rdd.getNumPartitions()), build_rows(s))[1])
    df = spark.createDataFrame([(i, f"string {i} of a batch") for i in range(40)], "str_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # few rows would else be put together again
    try:
        I.add_batch(df, 0, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks == [4]
    assert I.load_state(spark, str(tmp_path)).rules.count() == G.build(df).rules.count()


def test_files_of_the_stream_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    rows = [(i, 0, f"turn of the conversation {i} " * 5) for i in range(600)] + [(600, 0, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen, stream = [], I.build_stream
    monkeypatch.setattr(Q, "FILE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(Q.incremental, "build_stream", lambda spark, source, *a, **b: (seen.append((source, b.get("files_at_once", 1))), stream(spark, source, *a, **b)))
    got = {tuple(r) for r in Q.QUERIES["incremental_build"](spark, str(tmp_path)).collect()}
    (source, at_once), = seen
    sizes = [r.n for r in spark.read.parquet(source).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert max(sizes) < 20_000 and at_once == 3 and len(sizes) <= 3 * at_once
    assert got == {tuple(r) for r in Q.QUERIES["rules_per_level"](spark, str(tmp_path)).collect()}
