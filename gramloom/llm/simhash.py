"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint has, bit by bit, the majority of the XXH64 hashes of its word
shingles. Two fingerprints link at RADIUS or fewer differing bits.

Search. The 64 bits are cut into three blocks. Of RADIUS = 4 differing bits over three blocks
some block has at most one, so links are found by three vantage-point trees, one for each
block, over the Hamming distance of that block with search radius 1: in 64 bits and radius 4
the distances to any vantage point are so close together that a tree prunes next to nothing,
in a block with radius 1 most of it. Each node of a tree has a vantage point (drawn from the
node's number) and a middle radius: a fingerprint at home in the inner part that lies within
the search radius of the border also visits the outer part, and a visitor goes wherever the
triangle inequality can't rule a neighbour out. So any pair that is near in a block meets in
exactly the shard where one of the two is at home. The leaves are shards: (tree, leaf).

In a shard homes are compared with all on the full 64 bits, in blocks of pivots; what hangs
on a pivot is compared only with what the triangle inequality leaves, and only where it isn't
connected yet. A shard gives a spanning forest of its links, never all pairs, and connected
components over these links give the classes. Only distinct fingerprints are searched, so a
group of copies is one row; the depth of the trees follows the number of fingerprints.

Null text has no words, and no words give fingerprint zero, which links like any other. Very
long texts are hashed a stretch of words at a time. Repeated rows are linked. Null ids can be
in a class but never name it unless all are null. An empty table gives no rows. Other columns
are ignored by the contract view.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import cut, small_batches
from gramloom.llm.components import components

SHINGLE, RADIUS = 4, 4
#: Bits of the blocks, lowest first; RADIUS over their number, rounded down, is a block's search radius.
BLOCKS = (21, 21, 22)
#: Fingerprints that a leaf is meant to have at home, and the deepest tree.
LEAF, DEEPEST = 512, 24
#: Shingles hashed at once.
STRETCH = 1 << 15


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes (bigint), a stretch of them at a time; zero of none."""
    ones = sum((majority(hashes[a : a + STRETCH].view(np.uint64)) for a in range(0, len(hashes), STRETCH)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII blanks."""
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, STRETCH):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a : min(n, a + STRETCH)].tolist(), last[a : a + STRETCH].tolist(), strict=True)], np.uint64)
        ones += majority(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns named in `keep`, and fp: the fingerprint's bits as bigint."""
    small_batches(documents.sparkSession)
    sent = documents.select(*keep, F.col("text").alias("the text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).cast(pa.binary())
            fps = np.array([simhash(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(fps)], [*keep, "fp"])

    return sent.mapInArrow(run, f"{schema}, fp bigint")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shards(fps: np.ndarray, tree: int, depth: int, radius: int = RADIUS // len(BLOCKS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which fingerprint, leaf, at home?) of the tree over block `tree`: a row for each leaf that it lives in or visits."""
    bits, low = BLOCKS[tree], sum(BLOCKS[:tree])
    value = fps >> np.uint64(low) & np.uint64((1 << bits) - 1)
    middle = (bits - 1) // 2
    who, node, home = np.arange(len(fps)), np.ones(len(fps), np.uint64), np.ones(len(fps), bool)
    for _ in range(depth):
        vantage = _mix(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1)) & np.uint64((1 << bits) - 1)
        d = np.bitwise_count(value[who] ^ vantage).astype(np.int64)
        inner = np.where(home, d <= middle, d - radius <= middle)
        outer = np.where(home, d > middle, d + radius > middle)
        visits = home & inner & (d + radius > middle)
        who = np.concatenate([who[inner], who[outer], who[visits]])
        node = np.concatenate([2 * node[inner], 2 * node[outer] + np.uint64(1), 2 * node[visits] + np.uint64(1)])
        home = np.concatenate([home[inner], home[outer], np.zeros(int(visits.sum()), bool)])
    return who, node, home


class Forest:
    """Union-find over places of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, which: np.ndarray) -> np.ndarray:
        r = self.up[which]
        while (self.up[r] != r).any():
            r = self.up[r]
        return r


def link_shard(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place of root) that connect what is connected by links with a home end.

    Homes become pivots, a block at a time, unless they hang on one already, and are compared
    with all; the homes that hang on a pivot are compared with those at most 2 * radius from
    the pivot that aren't connected to it yet.
    """
    n, forest = len(fps), Forest(len(fps))
    pivot = np.full(n, -1)
    open_ = np.flatnonzero(home)
    while len(open_):
        now, open_ = open_[:block], open_[block:]
        near = np.bitwise_count(fps[now][:, None] ^ fps[None, :]) <= radius
        if len(now) < (total := int(near.sum())):
            first = near.argmax(axis=0)
            hit = np.flatnonzero(near.any(axis=0))
            mine = now[first[hit]]
            # one pivot of the block for each place, and links among pivots that share a place
            fresh = (pivot[hit] < 0) & ~np.isin(hit, now)
            pivot[hit[fresh]] = mine[fresh]
            for i, j in zip(hit.tolist(), mine.tolist(), strict=True):
                forest.join(i, j)
            if total > len(hit):
                share = near @ near.T
                for i, j in zip(*np.nonzero(np.triu(share, 1)), strict=True):
                    forest.join(int(now[i]), int(now[j]))
            open_ = open_[pivot[open_] < 0]
        pivot[now] = now
    hung = np.flatnonzero(home & (pivot >= 0) & (pivot != np.arange(n)))
    for p in np.unique(pivot[hung]).tolist():
        members = hung[pivot[hung] == p]
        reach = np.flatnonzero(np.bitwise_count(fps ^ fps[p]) <= 2 * radius)
        for a in range(0, len(members), block):
            part = members[a : a + block]
            others = reach[forest.roots(reach) != forest.find(p)]
            if not len(others):
                break
            near = np.bitwise_count(fps[part][:, None] ^ fps[others][None, :]) <= radius
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                forest.join(p, int(others[j]))
    root = forest.roots(np.arange(n))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all that are within RADIUS."""
    depth = min(DEEPEST, max(0, (n // LEAF).bit_length()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for tree in range(len(BLOCKS)):
                for a in range(0, len(fps), 1000):
                    who, leaf, home = shards(fps[a : a + 1000], tree, depth)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), tree, np.int32)), pa.array(leaf.view(np.int64)), pa.array(home), pa.array(fps[a : a + 1000][who].view(np.int64))], ["tree", "leaf", "home", "fp"])

    def compare(t: pa.Table) -> pa.Table:
        fps = t.column("fp").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy()
        order = np.lexsort((fps, ~home))  # one result whatever the order of rows
        fps, home = fps[order], home[order]
        i, j = link_shard(fps, home)
        return pa.table({"a": fps[i].view(np.int64), "b": fps[j].view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "tree int, leaf bigint, home boolean, fp bigint")
    return routed.groupBy("tree", "leaf").applyInArrow(compare, "a bigint, b bigint")


def classes(fps: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """fps (id, fp) to (fp, component_id): the least id of the class of each fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.min(id_column).alias("least")))
    stars = components(links(distinct, distinct.count()))
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def op2_simhash_near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: fingerprint and class of every document."""
    docs = cut(fingerprints(documents.select("doc_id", "text"), keep=["doc_id"]))
    named = classes(docs).select(F.col("fp").alias("f"), "component_id")
    return docs.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
