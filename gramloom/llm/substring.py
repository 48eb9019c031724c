"""Substring dedup by a log-structured fingerprint index.

Windows of WINDOW words are grouped by anchor: of the hashes of a window's grams of GRAM
words the least one is its anchor (the first of equal ones), and neighbouring windows mostly
share theirs. A group is told by the anchor's hash, `gram`, and the hash of all the words its
windows cover and of the anchor's place in them, `body`. Equal windows have equal anchors at
equal places, so a window can repeat only where its gram does, and all windows of a group
repeat where its body does.

The index is a folder of runs: immutable Parquet tables of (gram, body, n, one), each made from one
batch by partial sums, with one of its occurrences; they are cut into buckets by gram and sorted in
them, so a run is joined with another one bucket by bucket, without a shuffle. A batch becomes a run,
and that run is merge-joined with the older ones: their entries whose gram the batch holds are all
that is read of them. What repeats is then verified: groups whose body occurs twice repeat as a
whole, and an older single occurrence with them; for grams that occur with several bodies the windows
themselves are hashed again from the texts of the documents hit (of bodies that repeat, one occurrence
stands for all) and counted. Hashes are 64 bits of the gram and 64 of the body or window, so equality is
by 128 bits. Beyond FAN_IN runs they are merged into one.

What counts is in a manifest: the runs, and the batches that are in them with the marks that they
made. It is written under a new number and renamed, after the tables that it names and before
anything old is removed; what isn't in it is garbage of a run that was lost, and goes when the
index is opened. A batch whose id is in it gives its marks again and adds nothing.

Sums are partial before every shuffle and the marked side of each join is a sum's result, so
a passage in a third of all documents is spread over tasks. What is gathered by document is
bounded by the document: marks are distinct first, so repeated rows don't multiply.

Null and empty texts have no words and no windows; their kept text is empty. Texts shorter than
a window lose nothing. A repeated row is another occurrence: both lose their windows. Null ids
are ids like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import remove, shared_dir, small_batches, table

WINDOW, GRAM = 35, 8
#: Runs that an index has at most before they are merged.
FAN_IN = 4
#: Windows whose anchors are looked for at once.
STRETCH = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2^64, grown by doubling."""

    def __init__(self, base: int):
        self.base, self.array = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.array) < n:
            self.array = np.concatenate([self.array, self.array * np.uint64(pow(self.base, len(self.array), 1 << 64))])
        return self.array[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any span of a text's words."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        digest = xxhash.xxh3_64_intdigest
        w = np.fromiter((digest(x) for x in words), np.uint64, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(w * _DOWN.upto(self.n), out=self.sums[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * _UP.upto(self.n + 1)[a])


def groups(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, n, gram, body of the groups of windows of a text: windows start .. start+n-1."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    r = Rolling(words)
    at = np.arange(len(words) - GRAM + 1)
    g = r.spans(at, at + GRAM)
    wide = WINDOW - GRAM + 1
    n = len(words) - WINDOW + 1
    anchor = np.empty(n, np.int64)
    for a in range(0, n, STRETCH):
        b = min(n, a + STRETCH)
        anchor[a:b] = np.lib.stride_tricks.sliding_window_view(g[a : b + wide - 1], wide).argmin(axis=1) + np.arange(a, b)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    place = (anchor[start] - start).astype(np.uint64)
    body = _mix(r.spans(start, start + size + WINDOW - 1) + place * np.uint64(_INVERSE) + size.astype(np.uint64) * np.uint64(_BASE))
    return start, size, g[anchor[start]], body


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    for t in batch.column(column).cast(pa.binary()):
        yield (t.as_py() or b"").split()


def _keyed(documents: DataFrame) -> DataFrame:
    """A document is told by its id and the hash of its text, so repeated rows are one key and need no row numbers."""
    return documents.select("doc_id", F.xxhash64("text").alias("h"), "text")


def _groups_of(documents: DataFrame) -> DataFrame:
    """(gram, body, doc_id, h, start, n) of all groups."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [groups(w) for w in _texts(b, 2)]
            if not found:
                continue
            start, n, gram, body = (np.concatenate(x) for x in zip(*found, strict=True))
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found]))
            cols = [pa.array(gram.view(np.int64)), pa.array(body.view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["gram", "body", "doc_id", "h", "start", "n"])

    return _keyed(documents).mapInArrow(run, "gram bigint, body bigint, doc_id bigint, h bigint, start int, n int")


PLACE = "doc_id bigint, h bigint, start int, n int"


class FingerprintIndex:
    """Sorted immutable runs of (gram, body, seen, one) in a folder that all executors share."""

    KIND = "gram bigint, body bigint, seen bigint, one struct<doc_id: bigint, h: bigint, start: int, n: int>"

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        """Open the index under the path, or begin one. One writer at a time."""
        self.spark, self.fan_in = spark, fan_in
        self.path = path or f"{shared_dir(spark)}/gramloom-index-{uuid.uuid4().hex}"
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.buckets, self.runs, self.batches = 0, int(spark.conf.get("spark.sql.shuffle.partitions")), [], {}
        there = self._names(self.path)
        if known := max((x for x in self._names(f"{self.path}/manifest") if x.endswith(".json")), default=None):
            m = json.loads(spark.read.text(f"{self.path}/manifest/{known}", wholetext=True).first()[0])
            self.version, self.buckets, self.runs, self.batches = m["version"], m["buckets"], m["runs"], m["batches"]
        for x in there:
            if x not in ("manifest", *self.runs, *self.batches.values()):
                remove(spark, f"{self.path}/{x}")

    def _names(self, path: str) -> list[str]:
        p = self._jpath(path)
        return [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _commit(self, runs: list[str], batches: dict[str, str]) -> None:
        """The next manifest: whole under a name of its own, then renamed, which is one step."""
        folder, name = f"{self.path}/manifest", f"{self.version + 1:08d}.json"
        text = json.dumps({"version": self.version + 1, "buckets": self.buckets, "runs": runs, "batches": batches})
        out = self._fs.create(self._jpath(f"{folder}/{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._jpath(f"{folder}/{name}.tmp"), self._jpath(f"{folder}/{name}")):
            raise RuntimeError(f"another writer has made {folder}/{name}")
        self.version, self.runs, self.batches = self.version + 1, runs, batches
        remove(self.spark, f"{folder}/{self.version - 2:08d}.json")

    def _write(self, entries: DataFrame) -> str:
        """Entries with distinct (gram, body) as a run; no part of the index before it is committed."""
        name = f"run_{uuid.uuid4().hex}"
        dealt = entries.repartition(self.buckets, "gram")
        dealt.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "gram").sortBy("gram", "body").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table; a session that hasn't written it is told of its buckets."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} ({self.KIND}) using parquet clustered by (gram) sorted by (gram, body) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, f"{self.path}/{name}")

    def marks(self, batch_id: str) -> DataFrame:
        return self.spark.read.schema(PLACE).parquet(f"{self.path}/{self.batches[batch_id]}")

    def repeats(self) -> DataFrame:
        """(doc_id, h, start, n): windows start .. start+n-1 of all documents so far whose words begin elsewhere too."""
        none = self.spark.createDataFrame([], PLACE)
        return none if not self.batches else self.spark.read.schema(PLACE).parquet(*[f"{self.path}/{x}" for x in self.batches.values()]).distinct()

    def ingest(self, batch: DataFrame, batch_id: str, history: DataFrame | None = None) -> DataFrame:
        """Add a batch (doc_id, text). Returns its marks (doc_id, h, start, n): the repeated windows of its documents,
        and those of earlier ones that repeat because of it. history: the documents of the earlier batches (others among
        them do no harm), of which only the texts hit are cut up again."""
        if batch_id in self.batches:
            return self.marks(batch_id)
        spare = f"groups_{uuid.uuid4().hex}"
        at = table(_groups_of(batch), "groups", f"{self.path}/{spare}")
        name = self._write(at.groupBy("gram", "body").agg(F.count("*").alias("seen"), F.min(F.struct("doc_id", "h", "start", "n")).alias("one")))
        fresh, old = self.run(name), None
        for r in self.runs:
            # buckets of two runs: a merge join
            met = self.run(r).join(fresh.select("gram").distinct(), "gram", "left_semi")
            old = met if old is None else old.unionByName(met)
        old = self.spark.createDataFrame([], self.KIND) if old is None else table(old, "met", f"{self.path}/met_{uuid.uuid4().hex}")

        every = fresh.unionByName(old)
        total = every.groupBy("gram", "body").agg(F.sum("seen").alias("total"), F.min("one").alias("one"))
        shared = every.groupBy("gram").agg(F.min("body").alias("x"), F.max("body").alias("y"), F.sum("seen").alias("most")).where("most > 1").select("gram", (F.col("x") != F.col("y")).alias("several"))
        known = table(total.join(shared, "gram").select(F.col("gram").alias("g"), F.col("body").alias("b"), "total", "several", F.col("one").alias("first")), "known", f"{self.path}/known_{uuid.uuid4().hex}")
        same = (F.col("gram") == F.col("g")) & (F.col("body") == F.col("b"))
        keys = known.select("g", "b", "total", "several")
        hit = at.join(keys, same).select("gram", "doc_id", "h", "start", "n", "total")
        before = old.where("seen = 1").join(keys, same).select("gram", "one.*", "total")
        hit = table(hit.unionByName(before), "hits", f"{self.path}/hits_{uuid.uuid4().hex}")

        # windows of the other groups of shared grams, against each other and one occurrence of each repeated body
        alone = hit.where("total = 1").select("gram", "doc_id", "h", "start", "n", F.lit(1).alias("weight"))
        one = known.where("total > 1 and several").select(F.col("g").alias("gram"), "first.*", F.lit(2).alias("weight"))
        asked = alone.unionByName(one).groupBy(F.col("doc_id").alias("i"), F.col("h").alias("j")).agg(F.collect_list(F.struct("gram", "start", "n", "weight")).alias("asked"))
        texts = _keyed(batch if history is None else batch.select("doc_id", "text").unionByName(history.select("doc_id", "text")))
        texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select("doc_id", "h", "text", "asked").dropDuplicates(["doc_id", "h"])
        windows = table(_windows_of(texts), "windows", f"{self.path}/windows_{uuid.uuid4().hex}")
        twice = windows.groupBy("gram", "window").agg(F.sum("weight").alias("seen")).where("seen > 1").select(F.col("gram").alias("g"), F.col("window").alias("w"))
        single = windows.where("weight = 1").join(twice, (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w"))).select("doc_id", "h", "start", F.lit(1).alias("n"))

        made = f"marks_{uuid.uuid4().hex}"
        whole = hit.where("total > 1").select("doc_id", "h", "start", "n")
        table(whole.unionByName(single).distinct(), "marks", f"{self.path}/{made}")
        self._commit([*self.runs, name], self.batches | {batch_id: made})
        for x in self._names(self.path):
            if x.split("_")[0] in ("groups", "met", "known", "hits", "windows"):
                remove(self.spark, f"{self.path}/{x}")
        if len(self.runs) > self.fan_in:
            self.compact()
        return self.marks(batch_id)

    def compact(self) -> None:
        """Merge all runs into one; the old ones go after the manifest names the new one alone."""
        old = list(self.runs)
        if len(old) > 1:
            every = self.run(old[0])
            for r in old[1:]:
                every = every.unionByName(self.run(r))
            self._commit([self._write(every.groupBy("gram", "body").agg(F.sum("seen").alias("seen"), F.min("one").alias("one")))], self.batches)
            for r in old:
                self._forget(r)


def _windows_of(texts: DataFrame) -> DataFrame:
    """The hash of each window of the groups asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(3)
            flat, offsets = asked.flatten(), np.asarray(asked.offsets) - np.asarray(asked.offsets)[0]
            field = lambda c, flat=flat: flat.field(c).to_numpy(zero_copy_only=False)
            gram, start, n, weight = (field(c) for c in ("gram", "start", "n", "weight"))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, words in enumerate(_texts(b, 2)):
                s = slice(offsets[i], offsets[i + 1])
                k = n[s]
                at = np.repeat(start[s].astype(np.int64), k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                for to, x in zip(out, (np.full(len(at), i), np.repeat(gram[s], k), Rolling(words).spans(at, at + WINDOW).view(np.int64), at.astype(np.int32), np.repeat(weight[s], k)), strict=True):
                    to.append(x)
            row, gram, window, at, weight = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(row)), "h": b.column(1).take(pa.array(row)), "gram": pa.array(gram), "window": pa.array(window), "start": pa.array(at), "weight": pa.array(weight)})

    return texts.mapInArrow(run, "doc_id bigint, h bigint, gram bigint, window bigint, start int, weight int")


def cover(documents: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, kept, n_words, n_removed): documents without the words under the repeated windows; kept
    words are joined by one space."""
    distinct = repeats.select("doc_id", "h", "start", "n").distinct()
    marks = distinct.groupBy(F.col("doc_id").alias("i"), F.col("h").alias("j")).agg(F.collect_list((F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("n"))).alias("marks"))
    joined = _keyed(documents).join(marks, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left").select("doc_id", "h", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for words, marks in zip(_texts(b, 2), b.column(3), strict=True):
                if marks.is_valid:
                    m = marks.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, m >> 32, 1)
                    np.add.at(edge, (m >> 32) + (m & 0xFFFFFFFF) + WINDOW - 1, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    left = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                else:
                    left = words
                kept.append(b" ".join(left))
                total.append(len(words))
                gone.append(len(words) - len(left))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return joined.mapInArrow(run, "doc_id bigint, kept string, n_words bigint, n_removed bigint")


#: Batches in which the query gives its table to the index.
BATCHES = 2


def op4_substring_dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: the documents enter the index in batches; each is merge-joined with the runs of those before it."""
    docs = documents.select("doc_id", "text")
    index = FingerprintIndex(spark, fan_in=1)
    for i in range(BATCHES):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
        index.ingest(docs.where(part == i), str(i), docs.where(part < i))
    return cover(docs, index.repeats()).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
