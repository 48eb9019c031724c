"""WARC derivative builder.

Response records become, each, a metadata record (HTTP status, the source's headers and
digests, title, outlinks) and a conversion record (plain text). Both point at the response by
WARC-Refers-To and at each other, keep its target URI and date, and carry digests of their
own. Identifiers are name-based, so a rerun writes the same records.

Records are rows: warc_type, record_id, refers_to, target_uri, date, content_type,
payload_digest, block_digest, fields (further header lines), block (binary). read_warc() makes
them from WARC files, write_warc() makes WARC files of them through Spark's own text sink, so
any store that Spark writes works.

Null html or url counts as empty; a response whose block has no header end has no payload.
Records of other types pass read_warc() and are not derived from. Repeated rows give repeated
records with equal identifiers. An empty table gives no records. Payloads are taken whole.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import let

#: The alphabet of base32 digests, block-level elements, named entities.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…",
            "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€", "amp": "&"}
HIDDEN = "(?is)<(?:!--.*?-->|" + "|".join(rf"{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("head", "script", "style")) + ")"
CRLF = "\r\n"
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, fields string, block binary"


def digest(data: Column) -> Column:
    """sha1 of bytes as a labelled base32 digest."""
    five = lambda h: [F.substring(h, 1 + 5 * i, 5) for i in range(8)]
    return let(F.sha1(data), lambda h: F.concat(F.lit("sha1:"), F.translate(F.concat(*[
        F.lpad(F.conv(x, 16, 32), 4, "0") for x in five(h)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)))


def urn(*parts: Column | str) -> Column:
    """A name-based identifier of the parts."""
    named = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
    return let(F.md5(named), lambda h: F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")))


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw pages (page_id, url, html) as response records, with page_id beside them."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    made = pages.select(F.col("page_id"), url.alias("target_uri"), F.encode(html, "UTF-8").alias("payload"), F.encode(F.concat(head, html), "UTF-8").alias("block"))
    return made.select("page_id", "target_uri", "block", digest(F.col("payload")).alias("payload_digest"), digest(F.col("block")).alias("block_digest")).select(
        "page_id", F.lit("response").alias("warc_type"), urn("response", F.col("target_uri"), F.col("block_digest")).alias("record_id"), F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), "payload_digest", "block_digest", F.lit("").alias("fields"), "block")


def _resolved(piece: Column) -> Column:
    """What stood after an ampersand, with the character that it names, or with the ampersand."""
    name = F.substring_index(piece, ";", 1)
    code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
    char = let(code, lambda n: F.when((n < 1) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("�")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    known = F.create_map(*[F.lit(x) for e in ENTITIES.items() for x in e])
    found = F.coalesce(F.try_element_at(known, name), F.when(F.regexp_like(name, F.lit("^#(?:[xX][0-9a-fA-F]{1,5}|[0-9]{1,6})$")), char))
    return F.when(F.contains(piece, F.lit(";")) & found.isNotNull(), F.concat(found, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))


def plain_text(html: Column) -> Column:
    """Text of a page: no head, comments, scripts and styles; block elements end lines; entities resolved."""
    t = F.regexp_replace(html, HIDDEN, " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"</?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    t = let(t, lambda x: F.when(F.contains(x, F.lit("&")), let(F.split(x, "&", -1), lambda p: F.concat(
        p[0], F.array_join(F.transform(F.slice(p, 2, F.size(p) - 1), _resolved), "")))).otherwise(x))
    t = F.regexp_replace(t, r"[ \t\f\r]{2,}|[\t\f\r]", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def derive(records: DataFrame, *, carry: list[str] = ()) -> DataFrame:
    """The metadata and the conversion record of each response; `carry` names columns to keep beside them."""
    source = records.where("warc_type = 'response'").select(*carry, "record_id", "target_uri", "date", "payload_digest", "block_digest", F.col("block").cast("string").alias("all"))
    cut = F.locate(CRLF + CRLF, F.col("all"))
    split = source.withColumn("head", F.when(cut > 0, F.substring(F.col("all"), F.lit(1), cut - 1)).otherwise(F.col("all"))).withColumn(
        "raw", F.when(cut > 0, F.substring(F.col("all"), cut + 4, F.length("all"))).otherwise(F.lit("")))
    latin = F.lower(F.regexp_extract("head", r"(?i)charset=\"?([\w-]+)", 1)).isin("iso-8859-1", "latin1", "windows-1252")
    split = split.withColumn("html", F.when(latin, F.decode(F.col("raw").cast("binary"), "ISO-8859-1")).otherwise(F.make_valid_utf8("raw")))
    read = split.select(
        *carry, "record_id", "target_uri", "date", "payload_digest", "block_digest", "head", "html", urn("metadata", F.col("record_id")).alias("metadata_id"), urn("conversion", F.col("record_id")).alias("conversion_id"))

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    lines = F.split("head", CRLF, -1)
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    fields = F.concat(
        line("http-status", F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)),
        F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda h: line("source-header", h)), ""),
        line("source-payload-digest", F.coalesce("payload_digest", F.lit(""))), line("source-block-digest", F.coalesce("block_digest", F.lit(""))),
        line("conversion", F.col("conversion_id")), line("title", title), F.array_join(F.transform(links, lambda u: line("outlink", u)), ""))

    two = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), line("WARC-Concurrent-To", F.col("conversion_id")).alias("fields"), fields.alias("text")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), line("WARC-Concurrent-To", F.col("metadata_id")).alias("fields"), plain_text(F.col("html")).alias("text")))
    made = read.select(*carry, F.col("record_id").alias("refers_to"), "target_uri", "date", F.explode_outer(two).alias("r"))
    made = made.select(*carry, "refers_to", "target_uri", "date", "r.*").withColumn("block", F.encode("text", "UTF-8")).withColumn("block_digest", digest(F.col("block")))
    return made.select(*carry, "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.col("block_digest").alias("payload_digest"), "block_digest", "fields", "block")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, gzipped, one for each partition: a record is a line of the text sink that ends in two line ends."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit(CRLF))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"),
        line("WARC-Payload-Digest", "payload_digest"), line("WARC-Block-Digest", "block_digest"), F.coalesce("fields", F.lit("")), line("Content-Type", "content_type"),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    whole = F.concat(F.encode(head, "UTF-8"), F.coalesce("block", F.lit(b""))).cast("string")  # the cast keeps all bytes
    records.select(whole.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """Rows of the records of a WARC file, gzipped (one member or many) or not, one record in memory at a time. A
    record whose Content-Length is no number has an empty block; reading goes on at the next line that begins one."""
    names = {b"warc-type": "warc_type", b"warc-record-id": "record_id", b"warc-refers-to": "refers_to", b"warc-target-uri": "target_uri", b"warc-date": "date", b"content-type": "content_type", b"warc-payload-digest": "payload_digest", b"warc-block-digest": "block_digest"}
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        row, rest, size = dict.fromkeys(names.values()), [], 0
        while (x := stream.readline()).strip():
            name, _, value = x.partition(b":")
            if name.strip().lower() == b"content-length":
                size = int(value) if value.strip().isdigit() else 0
            elif key := names.get(name.strip().lower()):
                row[key] = value.strip().decode("utf-8", "replace")
            else:
                rest.append(x.rstrip(b"\r\n").decode("utf-8", "replace") + CRLF)
        if not x:
            return
        yield row | {"fields": "".join(rest), "block": stream.read(size)}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path; a file is read by one task, which holds it as it is stored and unpacks record by record."""
    kind = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORD.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                some: list[dict] = []
                for row in parse_records(content.as_py()):
                    some.append(row)
                    if len(some) == 500:
                        yield pa.RecordBatch.from_pylist(some, kind)
                        some = []
                yield pa.RecordBatch.from_pylist(some, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def op1_warc_derivatives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Both derivatives of every page, with their links and digests."""
    source = responses(pages)
    return derive(source, carry=["page_id"]).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", F.octet_length("block").cast("bigint").alias("content_length"))
