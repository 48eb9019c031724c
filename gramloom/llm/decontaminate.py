"""Benchmark decontamination by winnowing.

Words are hashed, and k-grams of words are hashed again (k is half a span). Of every window of as
many neighbouring k-grams as a span holds, the ones with the least hash are kept, on both sides: so
any span that a document shares with an item holds the same kept k-gram at the same offset, and
a join on kept k-grams misses none. With spans of ten words k is 5, a window is six k-grams,
and two of seven are kept. A hit is then extended: each span that the k-gram lies in is told by the
hashes of its two k-grams, and looked up among the spans of the items. Items shorter than a span are
one span of their own length, and the documents' grams of those lengths join in the same way.

The items are summed up before they meet the documents: kept grams and spans are distinct numbers,
and spans that are in the same items share a class. So a gram that many items share doubles nothing;
what is written for each document is its spans and its classes, and then its items.

Only built-in expressions; one pass over the texts; nothing but kept grams meets the
join. The benchmark side is broadcast where it is counted to be small.

Null and empty texts have no words. Null ids are ids like any other (an item without id
counts in n_items, and stands as empty string in the list). Repeated rows each get a
result of their own. Without items nothing is hit. Other columns are ignored. A text of any
length is one row, and each of its kept grams another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import ALNUM_GAP, ascii_lower, let, table

SPAN = 10
#: Grams, or spans, of the benchmark up to which they are broadcast (one to three numbers each); beyond, both sides are shuffled.
BROADCAST_GRAMS = 200_000


def words(text: Column) -> Column:
    """Whole text to array<string>: lower-cased A-Z, runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP, -1), "")


def grams(tokens: Column, k: int, then: Callable[[Column], Column]) -> Column:
    """then(hash of each k consecutive words). Three overlapping thirds tell a wider gram."""

    def wider(a: Column, n: int) -> Column:
        if n >= k:
            return let(F.slice(a, 1, F.greatest(F.size(a) - (k - 1), F.lit(0))), then)
        to = min(3 * n, k)
        return let(F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + min(n, to - n)), F.get(a, i + to - n))), lambda b: wider(b, to))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)) if k == 1 else tokens, lambda a: wider(a, 1))


def spans(g: Column, span: int) -> Column:
    """The hash of each span: its first and its last k-gram, which cover it."""
    k = (span + 1) // 2
    return F.transform(F.slice(g, 1, F.greatest(F.size(g) - (span - k), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(g, i + (span - k))))


def _entry(pos: Column, length: int, gram: Column, first: Column, within: Column) -> Column:
    return F.struct(pos.alias("pos"), F.lit(length).alias("len"), gram.alias("gram"), first.alias("first"), within.alias("within"))


def winnowed(tokens: Column, span: int) -> Column:
    """array<struct<pos, len, gram, first, within>>: the kept k-grams, where the first span with each begins, and
    the hashes of the spans with it; null for the others."""
    k = (span + 1) // 2
    w = span - k + 1

    def over(a: Column, pick: Callable[..., Column]) -> Column:
        return F.transform(a, lambda x, i: pick(x, *[F.get(a, i + j) for j in range(1, w)])) if w > 1 else a

    def kept(g: Column) -> Column:
        least = F.slice(over(g, F.least), 1, F.greatest(F.size(g) - (w - 1), F.lit(0)))
        # a gram is the least of some window that holds it if the greatest of their least ones isn't less
        padded = let(least, lambda m: F.concat(F.array_repeat(F.lit(None).cast("bigint"), w - 1), m))
        tops = let(padded, lambda m: over(m, F.greatest))
        return let(F.struct(tops.alias("top"), spans(g, span).alias("t")), lambda s: F.transform(g, lambda x, i: F.when(
            x <= F.get(s["top"], i), let(F.greatest(i - (w - 1), F.lit(0)), lambda at: _entry(i, span, x, at, F.slice(s["t"], at + 1, i - at + 1))))))

    return grams(tokens, k, kept)


def own_spans(tokens: Column, n: int) -> Column:
    """Each n-gram as a span of its own."""
    return grams(tokens, n, lambda g: F.transform(_short(g, n), lambda x, i: _entry(i, n, x, i, F.array(x))))


def _short(g: Column, n: int) -> Column:
    """Hashes that hold the length as well: a repeated word gives equal grams of two lengths."""
    return F.transform(g, lambda x: F.xxhash64(x, F.lit(n)))


def _few(df: DataFrame) -> DataFrame:
    """Rows of one to three numbers: broadcast if they are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df.hint("shuffle_merge")


def item_tables(benchmark: DataFrame, span: int) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """(grams: gram), (spans: t, c1, c2), (items: c1, c2, item), lengths of short items. c1, c2 is the class of the
    items that have the span: two sums of their hashes without carry."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    lengths = sorted(r["n"] for r in items.select(F.size("w").alias("n")).where(F.col("n").between(1, span - 1)).distinct().collect())
    own, at = F.when(F.size("w") >= span, winnowed(F.col("w"), span)), F.when(F.size("w") >= span, grams(F.col("w"), (span + 1) // 2, lambda g: spans(g, span)))
    for n in lengths:
        own = own.when(F.size("w") == n, own_spans(F.col("w"), n))
        at = at.when(F.size("w") == n, grams(F.col("w"), n, lambda g: _short(g, n)))
    kept = table(items.select(F.explode(own).alias("e")).where("e is not null").select("e.gram").distinct(), "grams")
    held = table(items.select("item", F.explode(at).alias("t")).distinct(), "spans")
    xor = lambda salt: F.bit_xor(F.xxhash64("item", F.lit(salt)))
    classes = table(held.groupBy("t").agg(xor(1).alias("c1"), xor(2).alias("c2")), "classes")
    return kept, classes, held.join(classes, "t").select("c1", "c2", "item").distinct(), lengths


def find_hits(documents: DataFrame, benchmark: DataFrame, *, span: int = SPAN) -> DataFrame:
    """One row per row of documents: uid, doc_id, n_words, hits (sorted array<struct<pos, len>>,
    distinct), items (sorted array<string>, distinct). uid tells repeated rows apart."""
    kept, classes, members, lengths = item_tables(benchmark, span)
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), words(F.col("text")).alias("w"))
    rows = docs.select("uid", let(F.col("w"), lambda w: F.concat(
        F.array(_entry(F.size(w), 0, F.lit(0).cast("bigint"), F.lit(0), F.array().cast("array<bigint>"))),  # tells n_words, also where nothing is hit
        winnowed(w, span), *[own_spans(w, n) for n in lengths])).alias("es"), "doc_id")
    # explode_outer: for explode() the optimizer adds a filter on the array, which computes it a second time
    rows = rows.select("uid", F.explode_outer("es").alias("e"), "doc_id").where("e is not null").select("uid", "doc_id", "e.*")
    # rows that are no grams get keys of their own, so a shuffle spreads them
    rows = rows.withColumn("gram", F.when(F.col("len") > 0, F.col("gram")).otherwise(F.xxhash64("uid")))
    near = rows.join(_few(kept.withColumn("known", F.lit(True))), "gram", "left").where("known or len = 0")
    near = near.select("uid", "doc_id", "pos", "len", "first", F.posexplode_outer("within").alias("off", "t"))
    near = near.withColumn("t", F.when(F.col("len") > 0, F.col("t")).otherwise(F.xxhash64("uid")))
    found = near.join(_few(classes), "t", "left").where("len = 0 or c1 is not null")
    hit = F.struct((F.col("first") + F.col("off")).alias("pos"), F.col("len").alias("len"))
    whole = table(found.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("len") == 0, F.col("pos"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("len") > 0, hit))).alias("hits"), F.collect_set(F.when(F.col("len") > 0, F.struct("c1", "c2"))).alias("classes")), "hits")
    items = whole.where(F.size("classes") > 0).select(F.col("uid").alias("u"), F.explode("classes").alias("c")).select("u", "c.*").join(members, ["c1", "c2"])
    items = items.groupBy("u").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return whole.join(items, F.col("uid") == F.col("u"), "left").select("uid", "doc_id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(hits: Column) -> Column:
    """Words under a union of hits, which are sorted by pos."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, lambda t, h: F.struct(
        (t["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(t["end"], h["pos"]))).alias("n"),
        F.greatest(t["end"], h["pos"] + h["len"]).alias("end")), lambda t: t["n"].cast("bigint"))


def op3_benchmark_decontamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract view: words, words hit, items, digest of the items."""
    return find_hits(documents, benchmark).select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), covered(F.col("hits")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
