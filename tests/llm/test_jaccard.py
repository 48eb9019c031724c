"""Near copies of the pipeline's stage against all pairs of shingle sets."""

import random

import corpus_pipeline as pipe
from gramloom.llm import jaccard


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _classes(texts):
    """The least place of each place's class, by all pairs."""
    root, s = list(range(len(texts))), [_shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def _texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(40))
    texts = [None, "", " ", "one two", "One two", "one two three", "a b c d e", "a b c d f"]
    for n in (30, 60, 200, 900):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.05):
                texts.append(" ".join(word() if rng.random() < share else w for w in base))
            texts.append(" ".join([*base, line]))
    # one passage in all, and a chain in which only neighbours are near
    texts += [f"{line} {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(30)]
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain[8 * i] = word()
        chain[8 * i + 1] = word()
        texts.append(" ".join(chain))
    return texts


def test_stage_joins_all_near_copies(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _classes(texts)
    assert len(set(want)) < len(texts) - 30
    assert sorted(r.doc_id for r in pipe.near_dedup(spark, docs, "").collect()) == sorted(set(want))


def test_order_and_blocks_do_not_matter(spark, monkeypatch):
    """Without a sample, and with groups cut into blocks of three rows."""
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, sig string")
    monkeypatch.setattr(jaccard, "FREQUENT", 1 << 30)
    monkeypatch.setattr(jaccard, "SPLIT", 3)
    assert {(r.id, r.component_id) for r in jaccard.classes(docs).collect()} == set(enumerate(_classes(texts)))


def test_which_row_of_equal_ones_stays(spark):
    rows = [(1, "one text of some words here", "b"), (1, "one text of some words here", "a"), (2, "one text of some words here", "0"), (3, None, "x"), (3, None, None)]
    kind = "doc_id long, text string, source string"
    for some in (rows, rows[::-1]):
        kept = pipe.near_dedup(spark, spark.createDataFrame(some, kind), "")
        assert kept.columns == ["doc_id", "text", "source"]
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], (3, None, "x")]))
