"""Round trips and identities of grammars, on small collections with every edge case."""

import pytest
from pyspark.sql import functions as F

from gramloom.operators import access as A
from gramloom.operators import derive as D
from gramloom.operators import edit as E
from gramloom.operators import grammar as G
from gramloom.operators import merge as X
from gramloom.plans import compress as C
from gramloom.sources import storage
from gramloom.sources import strings as S

TEXTS = ["", None, "A", "AA", "AAAAAAAAAAAAAAAA", "ABABABAB", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat", "the quick brown fox jumps over the lazy dog",
         "été à la plage, été", "line\nline\n\0end", "xxxxxyyyyyxxxxxyyyyyzzzz" * 4]


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "str_id long, text string")


@pytest.fixture(scope="module")
def stages(strings):
    plain = G.pack(G.build(strings))
    rl = G.run_length(plain)
    return {"plain": plain, "rl": rl, "simple": G.simplify(rl)}


@pytest.mark.parametrize("stage", ["plain", "rl", "simple"])
def test_round_trip(stages, strings, stage):
    row = D.verify(A.sample(stages[stage]), strings).first()
    assert (row.n_strings, row.n_equal) == (len(TEXTS), len(TEXTS))
    assert row.n_bytes == sum(len((t or "").encode()) for t in TEXTS)


@pytest.mark.parametrize("stage", ["plain", "rl", "simple"])
def test_access(spark, stages, stage):
    data = [(t or "").encode() for t in TEXTS]
    asked = [(i, s, a, a + n) for i, (s, a, n) in enumerate((s, a, n) for s, t in enumerate(data) for a in (0, 1, len(t) // 2, len(t) - 1, len(t)) for n in (0, 1, 7, 500) if a >= 0)]
    asked += [(10_000, 99, 0, 5), (10_001, 6, 5, 4), (10_002, 6, -1, 4)]
    want = {i: data[s][a : b + 1].hex().upper() for i, s, a, b in asked if s < len(data) and 0 <= a <= b and data[s][a : b + 1]}
    got = {r.qid: r.hex for r in A.access(A.sample(stages[stage]), spark.createDataFrame(asked, "qid long, str_id long, start long, stop long")).collect()}
    assert got == want


def test_identities(stages):
    plain, rl, simple = (G.size_row(stages[s]).first() for s in ("plain", "rl", "simple"))
    body = stages["plain"].rhs.count()
    assert plain.r == 256 + plain.n_lc + 1 and plain.g == 256 + body + plain.s
    removed = G.disposable(stages["rl"]).groupBy("kind").count().rdd.collectAsMap()
    assert simple.g == rl.g - removed["t"] - removed["lc"]
    assert simple.r == rl.r - removed["t"] - removed["lc"]
    assert G.collisions(G.Grammar(stages["plain"].sym.where("kind = 'lc'").select("lvl", "fp"), None)).isEmpty()


def test_children_are_a_level_below(stages):
    sym = stages["plain"].sym
    lv = sym.select(F.col("sym_id").alias("i"), F.col("lvl").alias("a"))
    lw = sym.select(F.col("sym_id").alias("j"), F.col("lvl").alias("b"))
    assert stages["plain"].rhs.join(lv, F.col("owner") == F.col("i")).join(lw, F.col("child") == F.col("j")).where("a <> b + 1").isEmpty()


@pytest.mark.parametrize("stage", ["rl", "simple"])
def test_bodies_keep_where_children_start(stages, stage):
    """So what follows needs no window over the bodies to find it."""
    p = stages[stage]
    for df, owner in ((p.rhs, "owner"), (p.roots, "str_id")):
        rows = df.select(owner, "pos", "child", "len", "start")
        assert G.with_starts(rows.drop("start"), owner).select(rows.columns).exceptAll(rows).isEmpty()
        plan = A._unfolded(p, df, owner, F.lit(0))._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "LeftOuter" not in plan


def test_merge_is_joint_build(strings):
    a, b = G.build(strings.where("str_id % 2 = 0")), G.build(strings.where("str_id % 2 = 1"))
    both, joint = G.merge(a, b), G.build(strings)
    assert both.rules.exceptAll(joint.rules).isEmpty() and joint.rules.exceptAll(both.rules).isEmpty()
    n = X.marks(a, b).groupBy("mark").count().rdd.collectAsMap()
    assert n.get(1, 0) + n.get(3, 0) == a.rules.count() and n.get(2, 0) == X.new_rules(a, b).count() and n.get(3, 0) == X.known_rules(a, b).count()


def test_placement(strings):
    a, b = G.build(strings.where("str_id < 7")), G.build(strings.where("str_id >= 7"))
    old = {}
    for r in a.rules.collect():
        old.setdefault(r.lvl, []).append(bytes(r.fp))
    for r in X.placement(a, b).collect():
        assert r.place == sum(x < bytes(r.fp) for x in old.get(r.lvl, []))


def test_delete_ranges(spark, strings):
    ranges = [(6, 4, 9), (6, 8, 12), (11, 0, 5), (4, 3, 900), (9, 1, 2), (77, 0, 3), (0, 0, 3)]
    cut = {s: bytearray((t or "").encode()) for s, t in enumerate(TEXTS)}
    want = {s: bytes(c for i, c in enumerate(t) if not any(x == s and a <= i <= b for x, a, b in ranges)) for s, t in cut.items()}
    out = E.delete_ranges(G.build(strings), strings, spark.createDataFrame(ranges, "str_id long, start long, stop long"))
    joint = G.build(spark.createDataFrame(list(want.items()), "str_id long, text binary"))
    assert out.grammar.rules.exceptAll(joint.rules).isEmpty() and joint.rules.exceptAll(out.grammar.rules).isEmpty()
    assert out.grammar.strings.exceptAll(joint.strings).isEmpty()


def test_empty(spark):
    none = spark.createDataFrame([], "str_id long, text string")
    for s in (none, spark.createDataFrame([(0, ""), (1, None)], "str_id long, text string")):
        p = G.simplify(G.run_length(G.pack(G.build(s))))
        assert p.rhs.isEmpty() and D.decompress(A.sample(p)).isEmpty()
        assert G.size_row(p).first().s == 0


def test_store(spark, strings, stages, tmp_path):
    storage.save_packed(stages["simple"], str(tmp_path / "g"), simplified=True, random_access=False)
    meta = storage.metadata(spark, str(tmp_path / "g")).first()
    assert meta.simplified and meta.has_rl and not meta.has_ra
    row = D.verify(A.sample(storage.load_packed(spark, str(tmp_path / "g"))), strings).first()
    assert row.n_strings == row.n_equal
    with pytest.raises(ValueError):
        storage.load_samples(spark, str(tmp_path / "g"))
    storage.save_packed(stages["simple"], str(tmp_path / "ra"), simplified=True, random_access=True)
    row = D.verify(storage.load_samples(spark, str(tmp_path / "ra")), strings).first()
    assert row.n_strings == row.n_equal
    g = G.build(strings)
    storage.save(g, str(tmp_path / "c"))
    assert storage.load(spark, str(tmp_path / "c")).rules.exceptAll(g.rules).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("first line\nsecond line, second line\n\nlast line\n")
    C.compress_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), C.Options(verify=True, random_access=True))
    got = {r["query"]: bytes.fromhex(r["hex"]).decode() for r in C.query_file(spark, str(tmp_path / "out"), ["0:0-4", "1:7-10", "3:5-99"]).collect()}
    assert got == {"0:0-4": "first", "1:7-10": "line", "3:5-99": "line"}
    with pytest.raises(ValueError):
        C.query_file(spark, str(tmp_path / "out"), ["0:5"])
    # stored grammars merge, and what is merged merges again
    (tmp_path / "more.txt").write_text("last line\n\nfirst\n")
    C.compress_file(spark, str(tmp_path / "more.txt"), str(tmp_path / "more"), C.Options(split_bytes=1 << 20))
    C.merge_files(spark, [str(tmp_path / "out"), str(tmp_path / "more")], str(tmp_path / "two"))
    C.merge_files(spark, [str(tmp_path / "two"), str(tmp_path / "more")], str(tmp_path / "three"), C.Options(random_access=True))
    with pytest.raises(ValueError):
        C.query_file(spark, str(tmp_path / "two"), ["0:0-4"])
    asked = {"0:0-4": "first", "4:0-8": "last line", "6:1-99": "irst", "7:5-5": "l", "9:0-0": "f"}
    assert {r["query"]: bytes.fromhex(r["hex"]).decode() for r in C.query_file(spark, str(tmp_path / "three"), list(asked)).collect()} == asked


def test_offsets(strings):
    at, want = 0, {}
    for i, t in enumerate(TEXTS):
        want[i] = at
        at += len((t or "").encode()) + 1
    assert {r.str_id: r.start for r in S.offsets(strings).collect()} == want
