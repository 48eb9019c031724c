"""Locally consistent parsing, vectorised over Arrow batches.

A symbol's fingerprint is the MD5 of its bytes' spelling (terminals) or of its children's
fingerprints (phrases), so equal text gives equal phrases in whatever task it is met, and
phrases need no shared dictionary. A round collapses runs of equal symbols, cuts each string
where a run is less than both neighbours, and replaces each phrase by its fingerprint; rounds
go on until a string is one symbol. All strings of a batch are parsed together as one array;
phrases that repeat in a batch are hashed once.

Null and empty strings have no phrases: level 0, no fingerprint.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_DOWN = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in enumerate((_BASE, _DOWN)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, m, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Symbols:
    """Fingerprints of numbered symbols: digests, their spelling, their halves as numbers, expansion lengths."""

    digest: np.ndarray
    spelling: np.ndarray
    high: np.ndarray
    low: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, digests: bytes, length: np.ndarray) -> Symbols:
        halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        return cls(np.frombuffer(digests, "V16"), np.frombuffer(binascii.hexlify(digests), "S32"), halves[:, 0], halves[:, 1], length)


TERMINALS = Symbols.of(b"".join(hashlib.md5(b"%02X" % b).digest() for b in range(256)), np.ones(256, np.int64))


@dataclass
class Round:
    """A round over some strings: where phrases begin, and which symbol each became."""

    level: int
    #: Input of the round: symbols of all strings one after the other, and the symbols' fingerprints.
    ids: np.ndarray
    symbols: Symbols
    #: String (place in the batch) and number within it, first symbol and size of each phrase.
    string: np.ndarray
    pos: np.ndarray
    start: np.ndarray
    size: np.ndarray
    #: Distinct phrases: one occurrence of each; number of the distinct phrase of each phrase.
    first: np.ndarray
    number: np.ndarray
    made: Symbols


def run_starts(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First places of maximal runs of equal symbols; begins marks the strings' first symbols."""
    new = begins.copy()
    new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)


def cuts(ids: np.ndarray, symbols: Symbols, begins: np.ndarray) -> np.ndarray:
    """First places of the runs that are strictly less than both neighbours in their string."""
    r = run_starts(ids, begins)
    if len(r) < 3:
        return r[:0]
    h, w = symbols.high[ids[r]], symbols.low[ids[r]]
    less_next = (h[:-1] < h[1:]) | ((h[:-1] == h[1:]) & (w[:-1] < w[1:]))
    inner = ~begins[r][1:-1] & ~begins[r][2:]  # neither the first run of its string nor the last
    return r[1:-1][inner & less_next[1:] & ~less_next[:-1]]


def _distinct(ids: np.ndarray, symbols: Symbols, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct phrase, number of each phrase) by 128 bits of span hashes."""
    up, down = _power_tables(len(ids) + 1)

    def spans(v: np.ndarray) -> np.ndarray:
        s = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((v[ids] | np.uint64(1)) * down[:-1], out=s[1:])
        return (s[start + size] - s[start]) * up[start]

    a, b = spans(symbols.high), spans(symbols.low)
    _, first, number = np.unique(a, return_index=True, return_inverse=True)
    if (b != b[first][number]).any() or (size != size[first][number]).any():
        _, first, number = np.unique(np.stack([a, b, size.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def _flat(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all symbols of the phrases, and the phrases' offsets in them."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1]), offsets


def rounds(texts: list[bytes | None], *, least: int = 1, most: int | None = None) -> Iterator[Round]:
    """All rounds of a batch: a string takes part until it is one symbol, and in the first round at any rate."""
    kept = [i for i, t in enumerate(texts) if t]
    string = np.array(kept, np.int64)
    ids = np.frombuffer(b"".join(texts[i] for i in kept), np.uint8).astype(np.int64)
    count = np.array([len(texts[i]) for i in kept], np.int64)
    symbols, level = TERMINALS, 1
    while len(string) and (most is None or level <= most):
        offset = np.cumsum(count) - count
        begins = np.zeros(len(ids), bool)
        begins[offset] = True
        heads = begins.copy()
        heads[cuts(ids, symbols, begins)] = True
        start = np.flatnonzero(heads)
        size = np.diff(np.concatenate([start, [len(ids)]]))
        first, number = _distinct(ids, symbols, start, size)
        at, bounds = _flat(start[first], size[first])
        spelled = symbols.spelling[ids[at]].tobytes()
        md5 = hashlib.md5
        edges = (32 * bounds).tolist()
        digests = b"".join([md5(spelled[a:b]).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)])
        length = np.add.reduceat(symbols.length[ids[at]], bounds[:-1])
        made = Symbols.of(digests, length)
        which = np.searchsorted(offset, start, side="right") - 1
        firsts = np.flatnonzero(begins[start])
        pos = np.arange(len(start)) - np.repeat(firsts, np.diff(np.concatenate([firsts, [len(start)]])))
        yield Round(level, ids, symbols, string[which], pos, start, size, first, number, made)
        count = np.bincount(which, minlength=len(string))
        more = count > 1
        ids = number[more[which]]
        string, count, symbols, level = string[more], count[more], made, level + 1


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binaries of digests, 16 bytes each, cut at the bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((16 * bounds).astype(np.int32)), pa.py_buffer(data.tobytes())])


def slices(bounds: np.ndarray, most: int = 1 << 26) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of phrases with at most so many children together: a column's offsets in bytes have 32 bits."""
    a = 0
    while a < len(bounds) - 1:
        b = int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1
        if b == a:
            raise ValueError(f"a phrase of {int(bounds[a + 1] - bounds[a])} symbols is more than a row holds ({most})")
        yield a, b
        a = b


def _digests(s: Symbols, which: np.ndarray) -> pa.Array:
    return _binary(s.digest[which], np.arange(len(which) + 1))


#: Bytes of text that are parsed at once: a round holds about 80 bytes of arrays for each, in every Python worker.
AT_ONCE = 1 << 18


def _batches(batches: Iterator[pa.RecordBatch], bytes_at_once: int = AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with texts of about so many bytes (a longer string is a slice's last), and the texts."""
    for b in batches:
        data = b.column(1).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = done = 0
        while a < len(ends):
            z = min(int(np.searchsorted(ends, done + bytes_at_once)) + 1, len(ends))
            yield b.slice(a, z - a), data.slice(a, z - a).to_pylist()
            a, done = z, int(ends[z - 1])


BUILT = "str_id bigint, lvl int, fp binary, rhs binary, len bigint"


def build_rows(strings: DataFrame) -> DataFrame:
    """(str_id, text) to the rows of a grammar: distinct phrases by batch (str_id null; rhs: the
    children's fingerprints, 16 bytes each), and for each string its level and fingerprint (rhs null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["str_id", "lvl", "fp", "rhs", "len"]
        for b, texts in _batches(batches):
            level, root = np.zeros(len(texts), np.int32), [None] * len(texts)
            for r in rounds(texts):
                at, bounds = _flat(r.start[r.first], r.size[r.first])
                for i, j in slices(bounds):
                    part = bounds[i : j + 1]
                    kids = r.symbols.digest[r.ids[at[part[0] : part[-1]]]]
                    yield pa.RecordBatch.from_arrays([pa.nulls(j - i, pa.int64()), pa.array(np.full(j - i, r.level, np.int32)), _digests(r.made, np.arange(i, j)), _binary(kids, part - part[0]), pa.array(r.made.length[i:j])], names)
                alone = np.flatnonzero(np.bincount(r.string, minlength=len(texts))[r.string] == 1)
                for s, k in zip(r.string[alone].tolist(), r.number[alone].tolist(), strict=True):
                    level[s], root[s] = r.level, r.made.digest[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level), pa.array(root, pa.binary()), pa.nulls(len(texts), pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64())], names)

    return strings.select(F.col("str_id").cast("bigint"), "text").mapInArrow(run, BUILT)


def parse_rows(strings: DataFrame, *, least: int = 1, most: int | None = None) -> DataFrame:
    """(str_id, lvl, pos, fp, start, size): every phrase of every round from `least` to `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _batches(batches):
            for r in rounds(texts, most=most):
                if r.level >= least:
                    base = r.start[np.flatnonzero(r.pos == 0)]
                    firsts = np.flatnonzero(r.pos == 0)
                    inside = r.start - np.repeat(base, np.diff(np.concatenate([firsts, [len(r.pos)]])))
                    for i, j in slices(np.arange(len(r.pos) + 1)):
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(r.string[i:j])), pa.array(np.full(j - i, r.level, np.int32)), pa.array(r.pos[i:j]), _digests(r.made, r.number[i:j]), pa.array(inside[i:j]), pa.array(r.size[i:j])],
                            ["str_id", "lvl", "pos", "fp", "start", "size"])

    return strings.select(F.col("str_id").cast("bigint"), "text").mapInArrow(run, "str_id bigint, lvl int, pos bigint, fp binary, start bigint, size bigint")


def run_rows(strings: DataFrame) -> DataFrame:
    """(str_id, run, byte, size): the maximal runs of equal bytes of every string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _batches(batches):
            kept = [i for i, t in enumerate(texts) if t]
            if not kept:
                continue
            ids = np.frombuffer(b"".join(texts[i] for i in kept), np.uint8).astype(np.int64)
            count = np.array([len(texts[i]) for i in kept])
            offset = np.cumsum(count) - count
            begins = np.zeros(len(ids), bool)
            begins[offset] = True
            r = run_starts(ids, begins)
            which = np.searchsorted(offset, r, side="right") - 1
            firsts = np.flatnonzero(begins[r])
            number = np.arange(len(r)) - np.repeat(firsts, np.diff(np.concatenate([firsts, [len(r)]])))
            size = np.diff(np.concatenate([r, [len(ids)]]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(kept)[which])), pa.array(number), pa.array(ids[r].astype(np.int32)), pa.array(size)], ["str_id", "run", "byte", "size"])

    return strings.select(F.col("str_id").cast("bigint"), "text").mapInArrow(run, "str_id bigint, run bigint, byte int, size bigint")


def byte_counts(strings: DataFrame) -> DataFrame:
    """(byte, n): counted by batch, so a task sends 256 rows a batch and not a row a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches):
            n = np.bincount(np.frombuffer(b"".join(t for t in texts if t), np.uint8), minlength=256)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["byte", "n"])

    return strings.select("str_id", "text").mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
