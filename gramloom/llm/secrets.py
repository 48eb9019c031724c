"""Secret scans: fixed patterns, and character Markov models of random strings
against ordinary identifiers.

Two first-order Markov models over printable ASCII give each candidate token a
log-likelihood ratio; tokens above the threshold become spans beside those of
the patterns, but for those that lie within one of them. Everything is built-in
expressions: the models are counted by a group-by over labelled samples and read
as one literal table of at most 128 x 128 scores, so no text leaves the JVM.

Null text counts as empty: no spans. Long texts are scanned whole. Spans that begin
at one place stand in the order of the kinds. Repeated rows each get their own
result; an empty table gives no rows; columns beside the ones named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import let, running_starts

#: The patterns of the contract; number of the group whose length counts, least length.
PATTERNS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # a run of the class is taken whole, so the least length can stand in the pattern
}
#: Tokens that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Least log-likelihood ratio, in thousandths of a nat, of a token that is reported.
THRESHOLD = 20_000
#: Parts of which the ordinary identifiers of the labelled samples are put together.
PARTS = [
    "account", "action", "address", "amount", "array", "author", "available", "balance", "between", "buffer",
    "button", "cache", "calculate", "category", "channel", "client", "collection", "column", "command", "comment",
    "company", "condition", "config", "connection", "container", "content", "context", "counter", "create", "current",
    "customer", "database", "default", "delete", "delivery", "description", "device", "directory", "document", "element",
    "empty", "enable", "entry", "error", "event", "exception", "export", "feature", "field", "filter",
    "folder", "format", "function", "gender", "general", "group", "handler", "header", "height", "history",
    "identifier", "image", "import", "index", "information", "initial", "insert", "instance", "interface", "internal",
    "invoice", "iterator", "language", "length", "library", "listener", "location", "logging", "manager", "mapping",
    "maximum", "member", "message", "method", "minimum", "module", "network", "notification", "number", "object",
    "option", "order", "output", "package", "parameter", "parent", "password", "pattern", "payment", "permission",
    "position", "previous", "process", "product", "profile", "project", "property", "provider", "query", "reader",
    "record", "reference", "register", "remove", "report", "request", "resource", "response", "result", "return",
    "schema", "search", "section", "security", "selection", "sequence", "server", "service", "session", "setting",
    "shipping", "signature", "source", "standard", "statement", "status", "storage", "stream", "string", "summary",
    "system", "table", "template", "temporary", "thread", "timeout", "transaction", "transfer", "update", "value",
    "anschluss", "bestellung", "einstellung", "verbindung", "zeichen", "ueberpruefung", "geschwindigkeit", "schnittstelle", "nachricht", "berechtigung",
    "utilisateur", "connexion", "quelque", "toujours", "parametre", "enregistrement", "bibliotheque", "recherche", "affichage", "mouvement",
    "usuario", "configuracion", "direccion", "contrasena", "busqueda", "archivo", "siguiente", "respuesta", "cantidad", "mensaje",
]
#: Counters that random strings are made from, and ordinary tokens with digits; copies of rulers and alphabets.
N_RANDOM, N_PLAIN, N_RULERS = 6000, 4000, 300
#: Rulers and alphabets.
RULERS = ["-" * 40, "=" * 40, "_" * 40, "/" * 40, "+" * 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"]


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(value, label): random strings (1) in the usual alphabets, made from digests of a counter, and ordinary
    tokens (0): pairs of PARTS in the usual spellings, dates, numbers, paths and names with them, rulers, alphabets."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.unhex(digest)
    random = spark.range(N_RANDOM).select(F.explode(F.array(
        digest, F.base64(raw), F.translate(F.base64(raw), "+/=", "-_"),
        F.substring(F.upper(F.translate(F.base64(F.unhex(F.sha2(digest, 256))), "+/=", "")), 1, 40))).alias("value"))
    a, b = F.col("a"), F.col("b")
    parts = F.array(*[F.lit(p) for p in PARTS])
    pairs = spark.range(1).select(F.explode(parts).alias("a")).select("a", F.explode(parts).alias("b"))
    plain = pairs.select(F.explode(F.array(
        F.concat_ws("_", a, b), F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("-", a, b),
        F.concat(a, b), F.upper(F.concat_ws("_", a, b)), F.concat_ws("/", a, b))).alias("value"))
    i = F.col("id")
    year, month, day = 1970 + i % 80, 1 + i * 7 % 12, 1 + i * 11 % 28
    date = F.format_string("%d-%02d-%02d", year, month, day)
    part = lambda k: F.get(parts, (i * k % len(PARTS)).cast("int"))
    numbered = spark.range(N_PLAIN).select(F.explode(F.array(
        F.concat(date, F.lit("/"), F.format_string("%d-%02d-%02d", year, 1 + i * 5 % 12, 1 + i * 3 % 28)), F.concat_ws("-", part(1), date), F.concat(F.format_string("%d/%02d/%02d/", year, month, day), part(3)),
        F.concat_ws("_", part(7), (i * 37 % 1000).cast("string")), F.concat(date, F.format_string("T%02d-%02d-00", i * 5 % 24, i * 13 % 60)), F.concat(part(5), (i % 100).cast("string")), (100_000_000_000 + i * 829348951).cast("string"))).alias("value"))
    rulers = spark.range(N_RULERS).select(F.explode(F.array(*[F.lit(x) for x in RULERS])).alias("value"))
    return random.withColumn("label", F.lit(1)).unionByName(plain.unionByName(numbered).unionByName(rulers).withColumn("label", F.lit(0)))


def train(samples: DataFrame) -> list[int]:
    """Scores of the 128 x 128 pairs of ASCII characters, row by row: round(1000 *
    log(P(next | char, random) / P(next | char, ordinary))), both with one added to each
    of 66 nexts. Samples: (value, label); other characters and null values or labels
    count for nothing. What reaches the driver is at most 2 * 128 * 128 counts."""
    pairs = (
        samples.where(F.col("label").isin(0, 1) & F.col("value").isNotNull())
        .select("label", F.filter(F.split("value", ""), lambda c: c != "").alias("c"))
        .where(F.size("c") > 1)
        .select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(
            F.ascii(F.col("c")[i]).alias("x"), F.ascii(F.col("c")[i + 1]).alias("y")))).alias("p"))
        .where((F.col("p.x") < 128) & (F.col("p.y") < 128))
        .groupBy("label", "p.x", "p.y").count()
    )
    n = {(r["label"], r["x"], r["y"]): r["count"] for r in pairs.collect()}
    rows = {(label, x): sum(n.get((label, x, y), 0) for y in range(128)) for label in (0, 1) for x in range(128)}
    p = lambda label, x, y: (n.get((label, x, y), 0) + 1) / (rows[label, x] + 66)
    return [round(1000 * math.log(p(1, x, y) / p(0, x, y))) for x in range(128) for y in range(128)]


def find(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches whose
    group has at least so many characters; positions in code points.

    What stands between the matches comes from split(), the matches from
    regexp_extract_all(); running sums of both lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def spans(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: (F.length(g) + F.length(x)).cast("bigint"))
        size = F.transform(counted if group else m, lambda x: F.length(x))
        placed = let(running_starts(steps), lambda s: F.zip_with(
            F.zip_with(s, steps, lambda a, b: a + b), F.arrays_zip(m.alias("m"), size.alias("n")),
            lambda e, x: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("value"), x["n"].alias("n"))))
        kept = F.filter(placed, lambda x: x["n"] >= least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(found, spans)).otherwise(none)


def score(token: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of an ASCII token in thousandths of a nat."""
    scores = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # one literal, folded when planned
    return let(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0).cast("bigint"), lambda t, i: t + F.get(scores, F.ascii(c[i]) * 128 + F.ascii(c[i + 1]))))


def scan(docs: DataFrame, model: list[int], *, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with a column `spans`: array<struct<start, ord, end, kind, value>> by start, then
    kind as listed. The kind `markov` has the candidate tokens that the models call random
    and that don't lie within a span of a pattern."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [*PATTERNS, "markov"]

    def as_kind(a: Column, kind: str) -> Column:
        return F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(kinds.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    base = F.concat(*[as_kind(find(t, *PATTERNS[k]), k) for k in PATTERNS])
    more = F.filter(find(t, CANDIDATE), lambda s: score(s["value"], model) >= threshold)
    return docs.withColumn("spans", let(base, lambda b: F.array_sort(F.concat(b, F.filter(
        as_kind(more, "markov"), lambda s: ~F.exists(b, lambda x: (x["start"] <= s["start"]) & (x["end"] >= s["end"])))))))


def op8_secret_scan(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract view: counts by kind, digest of the pattern spans, all spans."""
    docs = documents.select(F.col("doc_id"), F.col("text"))
    found = scan(docs, train(labelled_samples(spark))).select("doc_id", "spans")
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
