"""Language identification: averaged hashed subword embeddings and a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection.

A document is the mean of the embeddings of its subwords: the 2- to 4-grams of the UTF-8
bytes of its words (runs of letters, lower-cased, with a blank at both ends), hashed into
buckets. Scores are a softmax over a linear layer; a temperature fitted on held back
training rows, whole and in stretches of any length, calibrates them, and the rejection
threshold is a low quantile of the scores of those that were predicted rightly.

The sample for training is bounded: of each language the `per_language` distinct texts with
the least hashes (copies are one text), or fewer where many languages share `rows` in all, and
of each text a stretch of at most TRAIN_CHARS code points from a place that its hash tells. So it
is the same at every size of input but for chance. What is learned is a table of buckets by
languages, BUCKETS * 4 bytes a language; over MOST_LANGUAGES labels raise an error. Prediction
counts the buckets of whole texts, a bounded stretch at a time.

Letters are what isalpha() says. Null text, and text without a letter, is `und` with score 0 and
rejected. Empty tables, and tables without a labelled training row, predict `und`. Repeated rows get equal results; ties
between languages go to the first in code point order. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.llm.common import small_batches

BUCKETS = 1 << 15
DIM = 16
#: Bounds of the training sample: rows of a language, rows in all, code points of a row, words that a step of training sees.
PER_LANGUAGE = 600
ROWS = 120_000
TRAIN_CHARS = 4000
SNIPPET = 60
#: Labels that a model can have.
MOST_LANGUAGES = 2000
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
#: Stretches of each held back row that calibrate, beside the whole row; share of rightly predicted ones that is rejected.
STRETCHES, REJECT_QUANTILE = 8, 0.001

GAPS = re.compile(r"[\W\d_]+")
#: What is neither a gap nor a letter: numbers that aren't decimal digits, such as fractions.
NUMBERS = {c: " " for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_NUMBERS = str.maketrans(NUMBERS)
BITS = BUCKETS.bit_length() - 1


def letters(text: str | None) -> str:
    """The words of a text, lower-cased, a blank before, between and after; empty without a letter."""
    words = GAPS.sub(" ", f" {text.lower()} ") if text else " "
    if not words.isascii() and not NUMBERS.keys().isdisjoint(words):
        words = GAPS.sub(" ", words.translate(_NUMBERS))
    return words if words != " " else ""


def subwords(words: bytes) -> np.ndarray:
    """Buckets of the 2- to 4-grams of bytes that don't reach over a blank."""
    x = np.frombuffer(words, np.uint8).astype(np.uint32)
    inner = x != 32
    out, key, whole = [], x, np.ones(len(x), bool)
    for n in (2, 3, 4):
        if len(x) < n:
            break
        m = len(x) - n + 1
        key = key[:m] | (x[n - 1 :] << np.uint32(8 * (n - 1)))
        if n > 2:
            whole = whole[:m] & inner[n - 2 : n - 2 + m]
        h = ((key + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out.append(h if n == 2 else h[whole])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: Sum over the embedding of bucket times the linear layer: what a subword adds to each language.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], *, epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Model:
    """rows: (text, language). A tenth of them, by turns, is held back for calibration."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    kept, held = [], []
    for i, (text, lang) in enumerate(sorted(rows)):
        if found := letters(text):
            (held if i % 10 == 9 else kept).append((found.split(), languages.index(lang)))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    lin = rng.normal(0, 0.1, (DIM, len(languages)))
    bias = np.zeros(len(languages))
    steps, at = max(1, epochs * len(kept)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(kept)):
            words, y = kept[j]
            # a stretch of the text of random length, so that short texts are learned as well as long ones
            n = int(rng.integers(1, SNIPPET + 1))
            start = int(rng.integers(0, max(1, len(words) - n + 1)))
            ids = subwords(f" {' '.join(words[start : start + n])} ".encode())
            r = rate * (1 - at / steps)
            at += 1
            h = emb[ids].mean(axis=0)
            g = _softmax(h @ lin + bias)
            g[y] -= 1
            back = lin @ g
            lin -= r * np.outer(h, g)
            bias -= 0.1 * r * g
            np.add.at(emb, ids, -(r * 8 / len(ids)) * back)
    table = emb @ lin
    tried = []
    for words, y in held:
        tried.append((words, y))
        for _ in range(STRETCHES):
            n = int(rng.integers(1, SNIPPET + 1))
            start = int(rng.integers(0, max(1, len(words) - n + 1)))
            tried.append((words[start : start + n], y))
    logits = np.array([averaged(f" {' '.join(w)} ", table) + bias for w, _ in tried]).reshape(-1, len(languages))
    truth = np.array([y for _, y in tried], np.int64)
    if not len(truth):
        return Model(languages, table, bias, 1.0, 0.0)
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min((t for t in np.geomspace(0.25, 8, 31)), key=loss))
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = float(np.quantile(right, REJECT_QUANTILE)) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, temperature, threshold)


def averaged(words: str, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over the subwords; stretches end at blanks, so none is cut or lost."""
    data, counts, at = words.encode(), np.zeros(len(table)), 0
    while at < len(data) - 1:
        end = len(data) if len(data) - at <= STRETCH else data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end + (end < len(data) and data[end] == 32)
        counts += np.bincount(subwords(data[at:end]), minlength=len(table))
        at = end - 1
    return (counts.astype(table.dtype) @ table) / max(1.0, counts.sum())


def predict_one(model: Model, text: str | None) -> tuple[str, float]:
    words = letters(text)
    if not words or not model.languages:
        return "und", 0.0
    p = _softmax((averaged(words, model.table) + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(documents: DataFrame, *, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> list[tuple[str, str]]:
    """The bounded sample of (text, lang): of each language the distinct texts with the least hashes. Rows are
    chosen by hash before texts are looked at, by a threshold from the language's number of distinct texts, so
    nothing is sorted but what is nearly chosen already."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    if not counts:
        return []
    per_language = max(1, min(per_language, rows // len(counts)))
    # a third more than needed, and some more where few are needed: nothing is short by chance
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 40, int((1 << 40) * (1.3 * per_language + 30) / max(1, r["n"])) + 1))])
    near = labelled.withColumn("limit", F.element_at(limit, F.col("lang"))).where("h < limit").drop("limit")
    most = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0))
    cut = near.select("lang", "h", F.substring("text", F.pmod(F.col("h"), most + 1) + 1, F.lit(TRAIN_CHARS)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return [(r["text"], r["lang"]) for r in cut.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("text", "lang").collect()]


def predict(documents: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """The columns named in `keep`, lang_pred, score and rejected. Columns of these names are replaced."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    cols = keep if "text" in keep else [*keep, "text"]
    kept = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at, names = cols.index("text"), [f"c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict_one(sent.value, x.as_py()) for x in b.column(at)]
            lang = pa.array([g[0] for g in got], pa.string())
            score = pa.array([g[1] for g in got], pa.float64())
            rejected = pa.array([g[0] == "und" or g[1] < sent.value.threshold for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], lang, score, rejected], [*names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean").toDF(*keep, "lang_pred", "score", "rejected")


def op9_language_id(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: learned from two folds, predicted for all. `rejected` says which documents the calibrated
    threshold turns down; their prediction stands."""
    docs = documents.select("doc_id", "text", "lang").withColumn("held_out", is_held_out(F.col("doc_id")))
    model = fit(training_rows(docs.where("not held_out")))
    return predict(docs, model, keep=["doc_id", "held_out"])
