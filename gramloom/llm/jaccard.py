"""Near duplicates by the Jaccard similarity of word shingles: SimHash links first, and all that they
miss by prefix filtering.

Two documents link where the sets of their five-word shingles have a similarity of SIMILAR or
more; classes are the connected components of the links. No link is missed and none is made up,
but for equal XXH64 hashes of different shingles.

1. The vantage-point trees of simhash.py link sets whose fingerprints are near; each link of
their forest is checked on the whole sets. That joins nearly all of a group of near copies.
2. What is left is searched by prefix filtering. All shingles stand in one order; a set of n
shares one of its first n - ceil(0.8 n) + 1 with any set that is as similar, so sets meet in
groups by shingle. The order puts shingles that are frequent in a sample last, and else follows
the hash; it decides the cost, never the result. In a group a pair is possible where the sets
are in different classes so far and neither their sizes, nor the places of the shingle in their
orders (it is the first that they share, or they meet in another group too), nor the parities of
their buckets exclude the similarity: parities differ in no more buckets than the sets differ in
shingles. A group sends a spanning forest of its possible pairs, each set with its nearest ones,
never all pairs; they are checked on the whole sets, and what is similar becomes one class.
3. Rows that had a possible partner are compared once more, by as fine parities as the sets need
and the classes of by now, and all pairs that are possible still are checked.

Groups of more than SPLIT rows are cut into blocks, and blocks are compared by pairs, so no task
gets more than 2 * SPLIT rows of a group. Equal sets are one, so copies cost one row.

Texts of fewer than five words are one shingle; null texts and those without words are equal to
each other and to nothing else. An empty table gives no rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm import simhash
from gramloom.llm.common import cut, remove, shared_dir, small_batches, table
from gramloom.llm.components import components

SHINGLE, SIMILAR = 5, Fraction(4, 5)
#: Buckets of the parities; of the fine ones for each shingle, at least.
BUCKETS, FINE = 512, 4
#: Sets that are sampled for the order, and from how many of them on a shingle is frequent.
SAMPLE, FREQUENT = 4096, 4
#: Rows of a group that are compared with the others at once, rows of which all pairs are listed, rows of a block of a group.
BLOCK, FEW, SPLIT = 256, 32, 1 << 14


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes (bigint) of a UTF-8 text's shingles: A-Z lower-cased, words between ASCII blanks."""
    words = text.lower().split()  # of bytes: ASCII only
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def parities(toks: np.ndarray) -> bytes:
    """A bit for each of BUCKETS buckets, or of the next power of two from FINE a shingle on."""
    n = max(BUCKETS, 1 << (FINE * len(toks) - 1).bit_length() if len(toks) else 1)
    return np.packbits(np.bincount((toks.view(np.uint64) % np.uint64(n)).astype(np.int64), minlength=n) & 1).tobytes()


def folded(parity: bytes, size: int = BUCKETS // 8) -> np.ndarray:
    """The parities in fewer buckets, as bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint8).reshape(-1, size), axis=0)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = SIMILAR) -> bool:
    """Whether two sorted sets are at least as similar."""
    p, q = least.numerator, least.denominator
    return (p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b))


def sets(documents: DataFrame, often: tuple[np.ndarray, np.ndarray], *, size: int = SHINGLE, least: Fraction = SIMILAR) -> DataFrame:
    """(id, text) to (id, sig, fp, n, parity, fine, prefix): the hash of all shingles, their SimHash, their number, the
    parities, and the first shingles of the order that `often` makes, as bigints."""
    small_batches(documents.sparkSession)
    sent = documents.select("id", "text")
    kind = sent.schema["id"].dataType.simpleString()
    hot, times = often
    p, q = least.numerator, least.denominator

    def first(toks: np.ndarray) -> np.ndarray:
        k = len(toks) - (p * len(toks) + q - 1) // q + 1
        if not len(hot) or not len(toks):
            return toks[:k]
        at = np.minimum(np.searchsorted(hot, toks), len(hot) - 1)
        return toks[np.argsort(np.where(hot[at] == toks, times[at], 0), kind="stable")[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [shingles(t.as_py() or b"", size) for t in b.column(1).cast(pa.binary())]
            sig = np.array([xxhash.xxh64_intdigest(t.tobytes(), 7) if len(t) else 0 for t in all_], np.uint64).view(np.int64)
            fp = np.array([simhash.of_hashes(t) for t in all_], np.uint64).view(np.int64)
            fine = [parities(t) for t in all_]
            cols = [b.column(0), pa.array(sig), pa.array(fp), pa.array([len(t) for t in all_], pa.int64()), pa.array([folded(f).tobytes() for f in fine], pa.binary()), pa.array(fine, pa.binary()), pa.array([first(t).tobytes() for t in all_], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "sig", "fp", "n", "parity", "fine", "prefix"])

    return sent.mapInArrow(run, f"id {kind}, sig bigint, fp bigint, n bigint, parity binary, fine binary, prefix binary")


def frequent(documents: DataFrame, *, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; in how many texts of a sample of about SAMPLE texts): those that many hold."""
    one_of = max(1, documents.count() // SAMPLE)
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [shingles(t.as_py() or b"", size) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(all_))], ["tok"])

    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0).select("text").distinct()
    counts = sample.mapInArrow(run, "tok bigint").groupBy("tok").count().where(F.col("count") >= FREQUENT).toArrow()
    toks, times = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    order = np.argsort(toks)
    return toks[order], times[order]


def prefixes(found: DataFrame) -> DataFrame:
    """(tok, sig, pos): the first shingles of each set, and their places; copies in one task send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = {s: t for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and s not in seen}
            seen.update(new)
            if new:
                parts = [np.frombuffer(t, np.int64) for t in new.values()]
                sig = np.repeat(np.fromiter(new, np.int64, len(new)), [len(x) for x in parts])
                pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(sig), pa.array(pos)], ["tok", "sig", "pos"])

    return found.select("sig", "prefix").mapInArrow(run, "tok bigint, sig bigint, pos int")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of the keys, from batches sorted by them."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        same = np.ones(len(t), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            same &= x == x[-1]
        at = len(t) - int(same[::-1].argmin()) if not same.all() else 0
        if at:
            yield t.slice(0, at)
        rest = t.slice(at)
    if rest is not None:
        yield rest


def met(rows: DataFrame) -> DataFrame:
    """(tok, sig, pos) to (tok, sig, pos, size), where several sets meet; size: how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["tok"]):
            tok, sig, pos = (t.column(c).to_numpy() for c in ("tok", "sig", "pos"))
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])])
            tok, sig, pos = tok[new], sig[new], pos[new]
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            size = np.diff(np.append(start, len(tok)))
            each = np.repeat(size, size)
            many = each > 1
            yield pa.RecordBatch.from_arrays([pa.array(tok[many]), pa.array(sig[many]), pa.array(pos[many]), pa.array(each[many])], ["tok", "sig", "pos", "size"])

    return rows.repartition("tok").sortWithinPartitions("tok", "sig").mapInArrow(run, "tok bigint, sig bigint, pos int, size bigint")


class _Rows:
    """Rows of some groups: which pairs may be similar, and in how many buckets they differ."""

    def __init__(self, t: pa.Table, least: Fraction):
        self.p, self.q = least.numerator, least.denominator
        self.sig, self.root, self.n, self.pos, self.block = (t.column(c).to_numpy() for c in ("sig", "root", "n", "pos", "block"))
        sketches = t.column("sketch").to_pylist()
        self.width = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.place, self.bits, self.half = np.empty(len(sketches), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            which = np.flatnonzero(self.width == w)
            m = np.frombuffer(b"".join([sketches[i] for i in which.tolist()]), np.uint64).reshape(-1, w // 8)
            self.place[which], self.bits[w], self.half[w] = np.arange(len(which)), m, m[:, : w // 16] ^ m[:, w // 16 :]

    def cheap(self, x: np.ndarray, y: np.ndarray, within: np.ndarray | bool) -> np.ndarray:
        """What classes, blocks, sizes and places leave. within: rows of one block count as pairs too."""
        p, q = self.p, self.q
        na, nb = self.n[x], self.n[y]
        both = na + nb
        # the shingle is the first that they share: no more than what follows it in either can be shared
        shared = 1 + np.minimum(na - 1 - self.pos[x], nb - 1 - self.pos[y])
        return (self.root[x] != self.root[y]) & (q * np.minimum(na, nb) >= p * np.maximum(na, nb)) & ((p + q) * shared >= p * both) & (within | (self.block[x] != self.block[y]))

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(do the parities leave it?, in how many buckets do they differ?) of pairs that cheap() leaves: their sizes are so
        near that their parities have as many buckets, or one twice as many as the other."""
        apart = np.empty(len(x), np.int64)
        wx, wy = self.width[x], self.width[y]
        for w in self.bits:
            for v in (w // 2, w, 2 * w):
                if v in self.bits:
                    for a in np.array_split(at, len(at) // (1 << 15) + 1) if len(at := np.flatnonzero((wx == w) & (wy == v))) else ():
                        m, o = self.place[x[a]], self.place[y[a]]
                        apart[a] = np.bitwise_count((self.half if v < w else self.bits)[w][m] ^ (self.half if w < v else self.bits)[v][o]).sum(axis=1, dtype=np.int64)
        return (self.p + self.q) * apart <= (self.q - self.p) * (self.n[x] + self.n[y]), apart


def _forest(rows: _Rows, x: np.ndarray, y: np.ndarray, apart: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the pairs are a least spanning forest of each group's classes."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def find(k: tuple[int, int]) -> tuple[int, int]:
        while (v := up.get(k, k)) != k:
            up[k] = up.get(v, v)
            k = v
        return k

    keep = []
    for i in np.lexsort((apart, group)).tolist():
        g = int(group[i])
        a, b = find((g, int(rows.root[x[i]]))), find((g, int(rows.root[y[i]])))
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(i)
    return np.array(keep, np.int64)


def _large(rows: _Rows, start: int, end: int, within: bool, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, open x, open y) of a large group: its pairs, and rows that have a possible partner; spanning: each row is
    linked to the nearest one of each class before it."""
    tree = simhash.Forest(end - start)
    _, first, which = np.unique(rows.root[start:end], return_index=True, return_inverse=True)
    tree.up = first[which]  # rows of one class are one already
    for s in range(start, end, BLOCK):
        x = np.arange(s, min(s + BLOCK, end))
        for e in range(start, x[-1], 16 * BLOCK):
            y = np.arange(e, min(e + 16 * BLOCK, x[-1]))
            i, j = np.nonzero((x[:, None] > y) & rows.cheap(x[:, None], y, within))
            ok, apart = rows.possible(x[i], y[j])
            i, j, apart = i[ok], j[ok], apart[ok]
            if not spanning:
                yield x[i], y[j], x[i], y[j]
                continue
            a, b = [], []
            edges = np.searchsorted(i, np.arange(len(x) + 1))
            for r in np.unique(i).tolist():
                near, far = j[edges[r] : edges[r + 1]], apart[edges[r] : edges[r + 1]]
                near = near[np.argsort(far, kind="stable")]
                classes, nearest = np.unique(tree.roots(y[near] - start), return_index=True)
                for k in nearest[classes != tree.find(int(x[r]) - start)].tolist():
                    tree.join(int(x[r]) - start, int(y[near[k]]) - start)
                    a.append(x[r])
                    b.append(y[near[k]])
            yield np.array(a, np.int64), np.array(b, np.int64), x[np.unique(i)], y[np.unique(j)]


def compared(rows: DataFrame, least: Fraction = SIMILAR, *, spanning: bool) -> DataFrame:
    """(tok, sig, pos, size, root, n, sketch) to (tok, sig, pos, size, a, b). spanning: a forest of each group's
    possible pairs (a, b), and a row with null ends for each row that has a possible partner; else all possible pairs."""
    kind = "tok bigint, sig bigint, pos int, size bigint, a bigint, b bigint"
    blocks = F.ceil(F.col("size") / SPLIT).cast("int")
    mine = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    # a row meets each block of its group, its own one as well
    dealt = rows.select("*", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for t in _runs(batches, ["tok", "low", "high"]):
            tok, low, high = (t.column(c).to_numpy() for c in ("tok", "low", "high"))
            r = _Rows(t, least)
            start = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            size = np.diff(np.append(start, len(tok)))
            mixed = np.minimum.reduceat(r.root, start) != np.maximum.reduceat(r.root, start)
            few = mixed & (size <= FEW)
            x, y, group, open_ = [], [], [], np.zeros(len(tok), bool)
            for k in np.unique(size[few]).tolist():
                s, (u, v) = start[few & (size == k)], np.triu_indices(k, 1)
                x.append((s[:, None] + u).ravel())
                y.append((s[:, None] + v).ravel())
                group.append(np.repeat(s, len(u)))
            a, b = [], []
            if x:
                i, j, g = np.concatenate(x), np.concatenate(y), np.concatenate(group)
                left = r.cheap(i, j, low[i] == high[i])
                i, j, g = i[left], j[left], g[left]
                ok, apart = r.possible(i, j)
                i, j, g, apart = i[ok], j[ok], g[ok], apart[ok]
                open_[i] = open_[j] = True
                if spanning:
                    tree = _forest(r, i, j, apart, g)
                    i, j = i[tree], j[tree]
                a.append(i)
                b.append(j)
            for s, k in zip(start[mixed & ~few].tolist(), size[mixed & ~few].tolist(), strict=True):
                for i, j, u, v in _large(r, s, s + k, bool(low[s] == high[s]), spanning):
                    open_[u] = open_[v] = True
                    a.append(i)
                    b.append(j)
            if not a:
                continue
            i, j = r.sig[np.concatenate(a)], r.sig[np.concatenate(b)]
            pairs = [p for p in dict.fromkeys(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True)) if p not in sent]
            if len(sent) > 1 << 20:
                sent.clear()  # what is sent twice is dropped later
            sent.update(pairs)
            keep = t.filter(pa.array(open_)) if spanning else t.slice(0, 0)
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            none = lambda n, kind_: pa.nulls(n, kind_)
            cols = {c: pa.chunked_array([none(len(pairs), k), *keep.column(c).cast(k).chunks], k) for c, k in (("tok", pa.int64()), ("sig", pa.int64()), ("pos", pa.int32()), ("size", pa.int64()))}
            cols |= {c: pa.chunked_array([pa.array(ends[:, at].copy()), none(len(keep), pa.int64())], pa.int64()) for at, c in enumerate(("a", "b"))}
            yield from pa.table(cols).combine_chunks().to_batches()

    return dealt.repartition("tok", "low", "high").sortWithinPartitions("tok", "low", "high", "sig").mapInArrow(run, kind)


def verified(pairs: DataFrame, documents: DataFrame, found: DataFrame, least: Fraction = SIMILAR) -> DataFrame:
    """The pairs (a, b) that are similar, by their parities and then by the whole sets of their texts."""
    p, q = least.numerator, least.denominator

    def maybe(x: bytes, y: bytes, na: int, nb: int) -> bool:
        size = min(len(x), len(y))
        return (p + q) * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= (q - p) * (na + nb)

    def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([maybe(*x) for x in zip(*(b.column(c).to_pylist() for c in ("ca", "cb", "na", "nb")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[int, np.ndarray] = {}  # of the batch: a text that many pairs have is cut up once
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            for sigs, column in ((a, "ca"), (c, "cb")):
                for s, t in zip(sigs, b.column(column).cast(pa.binary()), strict=True):
                    if s not in made:
                        made[s] = shingles(t.as_py() or b"")
            keep = pa.array([similar(made[x], made[y], least) for x, y in zip(a, c, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    def joined(left: DataFrame, of_ends: Callable[[DataFrame], DataFrame], check: Callable, name: str) -> DataFrame:
        """The pairs that pass a check of the columns (sig, n, c) of both ends; only rows of these ends are moved."""
        ends = left.select(F.col("a").alias("e")).unionByName(left.select(F.col("b").alias("e"))).distinct()
        path = f"{shared_dir(left.sparkSession)}/gramloom-ends-{uuid.uuid4().hex}"
        used = table(of_ends(ends).dropDuplicates(["sig"]), "ends", path)
        of = lambda x: used.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"))
        out = table(left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(check, "a bigint, b bigint"), name)
        remove(left.sparkSession, path)
        return out

    def texts(ends: DataFrame) -> DataFrame:
        one = found.select("sig", "id").join(ends, F.col("sig") == F.col("e"), "left_semi").groupBy("sig").agg(F.min("id").alias("i")).withColumn("k", F.xxhash64("i"))
        rows = documents.select(F.col("id"), F.xxhash64("id").alias("h"), "text")
        return rows.join(one, (F.col("h") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).select("sig", F.lit(0).alias("n"), F.col("text").alias("c"))

    fine = lambda ends: found.select("sig", "n", F.col("fine").alias("c")).join(ends, F.col("sig") == F.col("e"), "left_semi")
    return joined(joined(pairs, fine, closer, "close"), texts, whole, "links")


def seeds(known: DataFrame) -> DataFrame:
    """(a, b): sets (sig, fp) that the SimHash trees connect; a and b are the least ones of their fingerprints, or a set and
    the least one of its fingerprint."""
    firsts = cut(known.groupBy("fp").agg(F.min("sig").alias("least")))
    of = lambda x: firsts.select(F.col("fp").alias(x), F.col("least").alias(f"s{x}"))
    trees = cut(simhash.links(firsts, firsts.count()).distinct()).join(of("a"), "a").join(of("b"), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    same = known.join(firsts, "fp").where("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    return trees.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(known: DataFrame, links_: DataFrame, sketch: Column) -> DataFrame:
    roots = components(links_)
    return known.join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "n", sketch.alias("sketch"))


def links(documents: DataFrame, found: DataFrame, least: Fraction = SIMILAR) -> DataFrame:
    """(a, b): links between the sets of sets() that connect all that are similar."""
    some = found.where("n > 0")
    near = verified(cut(seeds(some.select("sig", "fp").distinct())), documents, found, least)
    groups = table(met(prefixes(some)), "met")

    def left(rows: DataFrame, links_: DataFrame, sketch: str, name: str) -> DataFrame:
        """The rows of groups with several classes, and what compared() needs to know of them."""
        known = table(found.select("sig", "n", sketch).join(rows.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"]), name)
        placed = _rooted(known, links_, F.col(sketch))
        mixed = rows.join(placed.select("sig", "root"), "sig").groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tok")
        return rows.join(mixed, "tok", "left_semi").join(placed, "sig")

    step = table(compared(left(groups, near, "parity", "known"), least, spanning=True), "step")
    near = near.unionByName(verified(cut(step.where("a is not null").select("a", "b").distinct()), documents, found, least))
    rows = step.where("a is null").select("tok", "sig", "pos", "size").distinct()
    rest = compared(left(rows, near, "fine", "fine"), least, spanning=False)
    return near.unionByName(verified(cut(rest.select("a", "b").distinct()), documents, found, least))


def classes(documents: DataFrame, least: Fraction = SIMILAR) -> DataFrame:
    """(id, text) to (id, component_id): the least id of the class of each text."""
    documents = documents.select("id", "text")
    found = table(sets(documents, frequent(documents), least=least), "sets")
    distinct = cut(found.groupBy("sig").agg(F.min("id").alias("least")))
    hung = components(links(documents, found, least))
    rooted = distinct.join(hung, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.select("id", "sig").join(rooted.join(named, "root").select("sig", "component_id"), "sig").select("id", "component_id")
