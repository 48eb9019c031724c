"""SimHash classes, decontamination and substring dedup against brute force, with every edge case."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gramloom.llm import components as K
from gramloom.llm import decontaminate as D
from gramloom.llm import simhash as S
from gramloom.llm import substring as B

WORDS = [f"w{i}" for i in range(25)] + ["É", "é", "Of", "of", "d'or", "x-y"]


def texts(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared = line(70)
    rows = [(i, f"{line(r.randint(0, 50))} {' '.join(shared.split()[r.randint(0, 20):r.randint(40, 70)])} {line(r.randint(0, 50))}") for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "a null id"), (None, None), (103, "one"), (104, "One"), (105, line(34)), (106, "r " * 90), (107, shared), (107, shared), (107, shared + " and more")]
    return rows + [rows[0], (108, rows[1][1]), (109, rows[1][1] + " z")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, component_id int, uid string")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps):
    f = np.array(fps, np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4):
            root[find(i)] = find(i + 1 + int(j))
    return [find(i) for i in range(len(f))]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_simhash_query(spark):
    rows = texts(60, 1)
    got = S.op2_simhash_near_duplicates(spark, frame(spark, rows))
    fps = [fingerprint(t) for _, t in rows]
    root, least = classes(fps), {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert S.op2_simhash_near_duplicates(spark, frame(spark, rows).limit(0)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6))
def test_trees_lose_no_link(seed, depth):
    r = np.random.default_rng(seed)
    f = r.integers(0, 2**63, size=40, dtype=np.uint64)
    for _ in range(4):
        g = f[r.integers(0, len(f), 40)]
        for _ in range(r.integers(1, 6)):
            g = g ^ (np.uint64(1) << r.integers(0, 64, size=len(g)).astype(np.uint64))
        f = np.concatenate([f, g])
    f = np.unique(f)
    forest = S.Forest(len(f))
    for tree in range(len(S.BLOCKS)):
        who, leaf, home = S.shards(f, tree, depth)
        assert np.bincount(who[home], minlength=len(f)).tolist() == [1] * len(f)
        for x in np.unique(leaf):
            m = leaf == x
            for i, j in zip(*S.link_shard(f[who[m]], home[m], block=8)):
                forest.join(int(who[m][i]), int(who[m][j]))
    want = classes(f.tolist())
    got = forest.roots(np.arange(len(f))).tolist()
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (500, 400), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100, 500: 400} | {1000 + i: 1000 for i in range(1, 50)}
    assert K.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(D, "BROADCAST_GRAMS", 0)
    rows = texts(40, 2)
    items = [(0, " ".join(rows[3][1].split()[2:30])), (1, "of"), (2, "É w3"), (3, None), (4, "..."), (5, rows[107 - 100 + 40][1]), (5, "nothing of the kind"), (None, "w1 w2"), (7, "w1 " * 12), (8, "w1 w1 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.op3_benchmark_decontamination(spark, frame(spark, rows), bench)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_hits(rows, items), key=key)
    none = D.op3_benchmark_decontamination(spark, frame(spark, rows), bench.limit(0))
    assert none.where("contaminated or n_hit > 0 or n_items > 0").isEmpty() and none.count() == len(rows)
    assert D.op3_benchmark_decontamination(spark, frame(spark, rows).limit(0), bench).isEmpty()


def test_shared_passages(spark):
    """Passages of many items in many documents, borders of every span, repeated words: no span is lost, no gram multiplies."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    word = lambda: rnd.choice(["a", "b", "c"])
    items = [(i, " ".join([word() for _ in range(3)] + passage[: 10 + i % 20])) for i in range(60)] + [(100 + n, " ".join(["a"] * n)) for n in range(1, 10, 3)]
    rows = [(i, " ".join([word() for _ in range(9)] + passage[i % 25 : i % 25 + i % 17] + [word() for _ in range(9)])) for i in range(80)] + [(200, "a " * 3000 + " ".join(passage))]
    got = D.op3_benchmark_decontamination(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_hits(rows, items), key=key)


def brute_repeats(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = {}
    for _, w in split:
        for s in range(len(w) - 34):
            seen[tuple(w[s : s + 35])] = seen.get(tuple(w[s : s + 35]), 0) + 1
    out = []
    for i, w in split:
        gone = {j for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def test_substring_query(spark):
    rows = texts(60, 3)
    got = B.op4_substring_dedup(spark, frame(spark, rows))
    want = brute_repeats(rows)
    assert sum(r[2] for r in want) > 1000
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert B.op4_substring_dedup(spark, frame(spark, rows).limit(0)).isEmpty()


def removed(docs, index):
    got = B.cover(docs, index.repeats()).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=key)


def test_index_in_batches(spark, tmp_path):
    rows = texts(40, 4)
    docs = frame(spark, rows).select("doc_id", "text")
    path = str(tmp_path / "index")
    index = B.FingerprintIndex(spark, path, fan_in=2)
    for i in range(4):
        index.ingest(spark.createDataFrame(rows[i::4], "doc_id long, text string"), f"b{i}", docs)
        assert len(index.runs) <= 2
        so_far = [r for j in range(i + 1) for r in rows[j::4]]
        if i in (1, 3):
            assert removed(spark.createDataFrame(so_far, "doc_id long, text string"), index) == sorted(brute_repeats(so_far), key=key)
    assert "Exchange" not in "\n".join(x for x in index.run(index.runs[0]).join(index.run(index.runs[0]).select("gram").distinct(), "gram", "left_semi")._jdf.queryExecution().executedPlan().toString().split("\n") if "gram" in x and "hashpartitioning" in x)
    # a batch that comes again, and an index that is opened again by a session that knows no tables
    index.ingest(spark.createDataFrame(rows[1::4], "doc_id long, text string"), "b1", docs)
    for r in index.runs:
        spark.sql(f"drop table {r}")
    again = B.FingerprintIndex(spark, path)
    assert again.runs == index.runs and list(again.batches) == ["b0", "b1", "b2", "b3"]
    again.ingest(spark.createDataFrame([(500, rows[0][1])], "doc_id long, text string"), "b4", docs)
    more = [*rows, (500, rows[0][1])]
    assert removed(spark.createDataFrame(more, "doc_id long, text string"), again) == sorted(brute_repeats(more), key=key)


def test_lost_writers(spark, tmp_path, monkeypatch):
    """A writer is lost before its manifest, in the middle of a run, and between a merge and the removal of what was merged."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, line("a", 90)), (2, line("b", 90)), (3, line("c", 90)), (4, line("b", 40))]
    path, kind = str(tmp_path / "index"), "doc_id long, text string"
    part = lambda *at: spark.createDataFrame([rows[i] for i in at], kind)
    index = B.FingerprintIndex(spark, path, fan_in=1)
    index.ingest(part(0), "0")

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            index.ingest(part(1, 2), "1", part(0))
    (tmp_path / "index" / "run_half").mkdir()
    (tmp_path / "index" / "run_half" / "part-0.parquet").write_bytes(b"PAR1")
    index = B.FingerprintIndex(spark, path, fan_in=1)
    assert len(index.runs) == 1 and sorted(x.name for x in (tmp_path / "index").iterdir() if not x.name.startswith(".")) == sorted(["manifest", *index.runs, *index.batches.values()])
    with monkeypatch.context() as m:
        m.setattr(index, "_forget", lost)
        with pytest.raises(KeyboardInterrupt):
            index.ingest(part(1, 2), "1", part(0))
    index = B.FingerprintIndex(spark, path, fan_in=1)
    index.ingest(part(1, 2), "1", part(0))
    docs = part(0, 1, 2)
    assert len(index.runs) == 1 and removed(docs, index) == sorted(brute_repeats(rows[:3]), key=key) and all(r[2] == 0 for r in removed(docs, index))
    index.ingest(part(3), "2", docs)
    assert removed(part(0, 1, 2, 3), index) == sorted(brute_repeats(rows), key=key)


def test_identical_rows_are_linear(spark, tmp_path):
    text = " ".join(f"x{i}" for i in range(200))
    for n in (2, 300):
        docs = spark.createDataFrame([(7, text)] * n, "doc_id long, text string")
        marks = B.FingerprintIndex(spark, str(tmp_path / str(n))).ingest(docs, "0")
        assert marks.count() == len(B.groups(text.encode().split())[0])
    assert {tuple(r)[1:3] for r in B.op4_substring_dedup(spark, docs).collect()} == {(200, 200)}


def test_long_texts(spark, monkeypatch):
    """Several stretches of hashes and anchors, with the border inside a repeated passage."""
    r = random.Random(11)
    words = [f"w{r.randrange(3000)}" for _ in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[19_000:19_200]) + " tail"), (3, " ".join(words[:33_000]))]
    monkeypatch.setattr(S, "STRETCH", 1000)
    whole = [S.simhash(t.encode()) for _, t in rows]
    monkeypatch.undo()
    assert whole == [S.simhash(t.encode()) for _, t in rows]
    monkeypatch.setattr(B, "STRETCH", 997)
    some = [B.groups(t.encode().split()) for _, t in rows]
    monkeypatch.undo()
    assert all((x == y).all() for t, g in zip(rows, some) for x, y in zip(g, B.groups(t[1].encode().split())))
    got = B.op4_substring_dedup(spark, frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_repeats(rows), key=key)
