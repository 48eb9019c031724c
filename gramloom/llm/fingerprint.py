"""Document fingerprints by prefix polynomial hashes.

A text's code points c give prefix arrays P[i] = sum of c[j] * B^j for j < i, modulo two
primes. The hash of any span is (P[b] - P[a]) / B^a, so two spans are compared in constant
time, wherever they stand, and the longest common extension of two places is found by binary
search. Prefixes() is that structure.

A fingerprint keeps a few of those values: the text's length; the hash of the whole text; 32 bits
of the hashes of up to KEPT prefixes and as many suffixes at multiples of a power of two (of a
text of n code points at least n / KEPT apart, at most 2 n / KEPT); and a sketch, 16 bits each of
the SKETCH least hashes of its spans of SPAN code points. It is spelled as length, dot, hex digits.
From two fingerprints the longest common prefix and suffix are found by binary search over the
multiples that both have, so each is told to within such a step; they count for no more than the
shorter text. The likeness is the larger of (prefix + suffix) / longer length and the sketch's share
of equal places, and at most the ratio of the lengths. Equal texts have equal fingerprints and likeness 1. The query also returns how many
code points the text has in common with the edited one and with the next one at their beginnings,
exactly, from the prefix arrays.

Null text counts as empty; two empty texts are alike, an empty and another text are not at all.
Rows are put in order of doc_id (null first), ties by text; the next row of the last is the
first. Repeated rows are neighbours. An empty table gives no rows. A task holds a batch of rows
at a time; one row alone is its own next. Rows of one doc_id are dealt out by the beginnings of their
texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import small_batches, table

#: Two primes under 2^31, a base for each.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
#: Prefixes and suffixes kept at most, places of the sketch, code points of its spans.
KEPT, SKETCH, SPAN = 32, 32, 24
#: A place of the sketch without a span.
EMPTY = (1 << 16) - 1
#: Characters of a text by which rows of one doc_id are dealt out.
DEALT = 16


class Powers:
    """B^i and B^-i modulo p, grown by doubling as longer texts come."""

    def __init__(self, base: int, p: int):
        self.p = p
        self.base = (base, pow(base, -1, p))
        self.arrays = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.arrays[0]) < n:
            m = len(self.arrays[0])
            self.arrays = [np.concatenate([a, a * np.uint64(pow(b, m, self.p)) % np.uint64(self.p)]) for a, b in zip(self.arrays, self.base, strict=True)]
        return self.arrays[0][:n], self.arrays[1][:n]


_POWERS = [Powers(b, p) for b, p in zip(BASES, MODULI, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix arrays of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for w in _POWERS:
            up, _ = w.upto(self.n + 1)
            s = np.zeros(self.n + 1, np.uint64)
            # terms are under 2^31, so sums of up to 2^33 of them fit
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: self.n] % np.uint64(w.p), out=s[1:])
            self.sums.append(s % np.uint64(w.p))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [a, b)."""
        out = np.zeros(len(a), np.uint64)
        for s, w in zip(self.sums, _POWERS, strict=True):
            p = np.uint64(w.p)
            _, down = w.upto(self.n + 1)
            out = out << np.uint64(31) | (s[b] + p - s[a]) % p * down[a] % p
        return out

    def span(self, a: int, b: int) -> int:
        out = 0
        for s, w in zip(self.sums, _POWERS, strict=True):
            out = out << 31 | (int(s[b]) - int(s[a])) % w.p * int(w.upto(self.n + 1)[1][a]) % w.p
        return out


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """How many code points agree from place i of x and place j of y on."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if x.span(i, i + mid) == y.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def _step(n: int) -> int:
    """The least power of two of which at most KEPT multiples fit."""
    g = 1
    while n // g > KEPT:
        g *= 2
    return g


Raw = tuple[int, bytes]


def raw_fingerprint(p: Prefixes) -> Raw:
    """(length, bytes): whole hash, prefixes, suffixes, sketch."""
    n = p.n
    at = np.arange(1, n // _step(n) + 1) * _step(n) if n else np.zeros(0, np.int64)
    low = np.uint64((1 << 32) - 1)
    part = lambda h: ((h ^ h >> np.uint64(31)) & low).astype(">u4").tobytes()
    zero, end = np.zeros(len(at), np.int64), np.full(len(at), n)
    k = min(SPAN, n)
    start = np.arange(n - k + 1) if n else np.zeros(0, np.int64)
    h = p.hashes(start, start + k) * np.uint64(0x9E3779B97F4A7C15)
    # one permutation, split in SKETCH places: each keeps the least of its hashes
    place, value = (h >> np.uint64(59)).astype(np.int64) % SKETCH, (h >> np.uint64(20)) & low
    least = np.full(SKETCH, 1 << 33, np.uint64)
    np.minimum.at(least, place, value)
    sketch = np.where(least <= low, least % np.uint64(EMPTY), np.uint64(EMPTY)).astype(">u2").tobytes()
    return n, p.span(0, n).to_bytes(8, "big") + part(p.hashes(zero, at)) + part(p.hashes(n - at, end)) + sketch


def spelled(raw: Raw) -> str:
    return f"{raw[0]}.{raw[1].hex()}"


def fingerprint(codes: np.ndarray) -> str:
    return spelled(raw_fingerprint(Prefixes(codes)))


def _agreed(a: bytes, b: bytes, step_a: int, step_b: int) -> int:
    """Length to which two lists of hashes at multiples agree, by binary search over the coarser ones."""
    step = max(step_a, step_b)
    x = lambda s, g, i: s[4 * (i * step // g - 1) : 4 * (i * step // g)]
    low, high = 0, min(len(a) // 4 * step_a, len(b) // 4 * step_b) // step
    while low < high:
        mid = (low + high + 1) // 2
        if x(a, step_a, mid) == x(b, step_b, mid):
            low = mid
        else:
            high = mid - 1
    return low * step


def raw_likeness(a: Raw, b: Raw) -> float:
    if a == b:
        return 1.0
    (n, x), (m, y) = a, b
    if not n or not m:
        return 0.0
    parts = lambda n, x: (x[8 : 8 + 4 * (k := n // _step(n))], x[8 + 4 * k : 8 + 8 * k], np.frombuffer(x, ">u2", SKETCH, 8 + 8 * k))
    (pa_, sa, ka), (pb, sb, kb) = parts(n, x), parts(m, y)
    # a repeat may match as prefix and as suffix at once
    ends = min(_agreed(pa_, pb, _step(n), _step(m)) + _agreed(sa, sb, _step(n), _step(m)), n, m) / max(n, m)
    used = (ka != EMPTY) | (kb != EMPTY)
    # nor can spans be shared beyond the shorter text, however often they repeat
    return min(min(n, m) / max(n, m), max(ends, float((ka == kb)[used].mean()) if used.any() else 0.0))


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints."""
    back = lambda s: (int(s.partition(".")[0]), bytes.fromhex(s.partition(".")[2]))
    return raw_likeness(back(a), back(b))


def edited(text: str, after: str) -> str:
    """The last quarter of the text's code points replaced by as many of the next text's first, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, own binary, edited_chars bigint, edited binary, near_edited double, near_next double, prefix_edited bigint, prefix_next bigint"
_KIND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()), ("edited_chars", pa.int64()), ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("prefix_edited", pa.int64()), ("prefix_next", pa.int64())])


class _Text:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.prefixes = doc_id, text, Prefixes(code_points(text))
        self.raw = raw_fingerprint(self.prefixes)

    def row(self, after: "_Text") -> dict:
        """RESULT of the text, `after` being the next one."""
        e = edited(self.text, after.text)
        other = _Text(None, e) if e != self.text else self
        return {"doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), "own": self.raw[1], "edited_chars": len(e), "edited": other.raw[1],
                "near_edited": raw_likeness(self.raw, other.raw), "near_next": raw_likeness(self.raw, after.raw),
                "prefix_edited": common_extension(self.prefixes, 0, other.prefixes, 0), "prefix_next": common_extension(self.prefixes, 0, after.prefixes, 0)}


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each with the next one. The first and the last text of the task also go out as they
    are, so that the last one can meet the next task's first."""
    kind = _KIND.append(pa.field("task", pa.int32())).append(pa.field("first", pa.string())).append(pa.field("last", pa.string()))
    task, held, first = TaskContext.get().partitionId(), None, None
    plain = {"task": None, "first": None, "last": None}
    for b in batches:
        out = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            now = _Text(i, t.as_py() or "")
            if held is None:
                first = now.text
            else:
                out.append(held.row(now) | plain)
            held = now
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict.fromkeys(_KIND.names) | {"doc_id": held.doc_id, "task": task, "first": first, "last": held.text}], kind)


def with_neighbours(documents: DataFrame) -> DataFrame:
    """ROWS for each row: one range shuffle of the texts; only a row of each task takes a second step."""
    small_batches(documents.sparkSession)
    # by doc_id and a short beginning: what the ranges are sampled by goes to the driver
    begin = F.substring("text", 1, DEALT)
    ordered = documents.select("doc_id", "text", begin.alias("begin")).repartitionByRange("doc_id", "begin").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    rows = table(ordered.mapInArrow(_walk, f"{ROWS}, task int, first string, last string"), "fingerprints")
    # a row of each task that had rows; their numbers alone are put in order, the texts meet in a join
    ends = rows.where("task is not null").select("task", "doc_id", "first", "last")
    cycle = ends.select("task").selectExpr("task as t", "coalesce(lead(task) over (order by task), first(task) over (order by task)) as next")
    after = ends.select(F.col("task").alias("u"), F.col("first").alias("after"))
    pairs = ends.select("task", "doc_id", "last").join(cycle, F.col("task") == F.col("t")).join(after, F.col("next") == F.col("u")).select("doc_id", "last", "after")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([_Text(r["doc_id"], r["last"]).row(_Text(None, r["after"])) for r in b.to_pylist()], _KIND)

    return rows.where("task is null").drop("task", "first", "last").unionByName(pairs.mapInArrow(join, ROWS))


def op7_document_fingerprints(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: every text, its edited text and the next one, by fingerprint."""
    spell = lambda n, raw: F.concat(F.col(n).cast("string"), F.lit("."), F.lower(F.hex(raw)))
    return with_neighbours(documents).select(
        "doc_id", "n_chars", "edited_sha256", spell("n_chars", "own").alias("fingerprint"), spell("edited_chars", "edited").alias("edited_fingerprint"), "near_edited", "near_next", "prefix_edited", "prefix_next")
