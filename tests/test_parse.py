"""Vectorised parsing against a plain model of the same rules."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramloom.operators import parse as P


def model(text: bytes) -> dict:
    """(level, pos) -> fingerprint, one string at a time."""
    fps, out, level = [hashlib.md5(b"%02X" % b).hexdigest() for b in text], {}, 0
    while text and (len(fps) > 1 or level == 0):
        level += 1
        runs = [k for k in range(len(fps)) if k == 0 or fps[k] != fps[k - 1]]
        cuts = [b for a, b, c in zip(runs, runs[1:], runs[2:]) if fps[a] > fps[b] < fps[c]]
        edges = [0, *cuts, len(fps)]
        fps = [hashlib.md5("".join(fps[a:b]).encode()).hexdigest() for a, b in zip(edges, edges[1:])]
        out |= {(level, i): x for i, x in enumerate(fps)}
    return out


def vectorised(texts: list) -> dict:
    return {(s, r.level, p): r.made.digest[k].tobytes().hex() for r in P.rounds(texts) for s, p, k in zip(r.string.tolist(), r.pos.tolist(), r.number.tolist())}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode)), max_size=12))
def test_rounds(texts):
    assert vectorised(texts) == {(i, *k): v for i, t in enumerate(texts) if t for k, v in model(t).items()}


def test_edges():
    texts = [b"", None, b"A", b"AAAA", b"ABABAB", b"aaab" * 9, "é\n\0".encode() * 7, b"aaab" * 9, b"aaab" * 10]
    assert vectorised(texts) == {(i, *k): v for i, t in enumerate(texts) if t for k, v in model(t).items()}


def test_lengths_and_children():
    for r in P.rounds([b"locally consistent parsing of a text, locally consistent"]):
        at, bounds = P._flat(r.start[r.first], r.size[r.first])
        assert [sum(r.symbols.length[r.ids[at[a:b]]]) for a, b in zip(bounds, bounds[1:])] == r.made.length.tolist()


def test_batches_do_not_change_rules(spark):
    rows = [(i, f"text {i % 3} and text {i % 5} " * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "str_id long, text string")
    one, many = (df.coalesce(1), df.repartition(7))
    rules = lambda d: {tuple(map(bytes, r)) for r in P.build_rows(d).where("rhs is not null").select("fp", "rhs").collect()}
    assert rules(one) == rules(many)


def test_slices():
    bounds = np.array([0, 3, 5, 6, 10, 14])
    assert list(P.slices(bounds, 5)) == [(0, 2), (2, 4), (4, 5)]
    assert list(P.slices(np.array([0]))) == []
    with pytest.raises(ValueError):
        list(P.slices(bounds, 3))


def test_a_worker_holds_a_bounded_part_of_a_batch():
    texts = [None, "", *["x" * 5000] * 2000, "y" * (3 * P.AT_ONCE), "z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["str_id", "text"])
    parts = list(P._batches(iter([batch, batch.slice(0, 0)])))
    assert [t for _, part in parts for t in part] == [None if t is None else t.encode() for t in texts]
    assert [i for b, _ in parts for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t or b"") for t in part[:-1]) < P.AT_ONCE <= 1 << 20 for _, part in parts)


def peak_mb(f, batches):
    """MB that f holds at most while its rows are taken batch by batch; the input is held by the caller."""
    tracemalloc.start()
    try:
        for _ in f(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch_of(n_bytes):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 500, np.uint8).tobytes().decode() for _ in range(n_bytes // 500)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["str_id", "text"])


@pytest.mark.parametrize("step", [P.build_rows, P.parse_rows, P.run_rows, P.byte_counts])
def test_memory_of_a_step_does_not_grow_with_its_batches(spark, monkeypatch, step):
    held = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: held.append(f) or spark.createDataFrame([], schema))
    step(spark.createDataFrame([], "str_id bigint, text string"))
    small, large = batch_of(1_000_000), batch_of(4_000_000)
    peak_mb(held[0], [small])  # tables that stay
    few, many = peak_mb(held[0], [small]), peak_mb(held[0], [large])
    assert many < 1.25 * few + 4 and many < 40
