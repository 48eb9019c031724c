"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths (names only, in sorted order): a
record's fingerprint selects its mapping, whatever its values are. Mappings are data: where
the list of turns is, which fields hold role and text, or which field makes which turn.
Paths that no mapping names are no part of a fingerprint, so further fields do no harm.
Records of several layouts stand in one table, as columns that are null where a record has
another layout (`canonical_rows`), or as JSON (`canonical_records`); what no mapping fits has
null turns and keeps its fingerprint, for a report.

Canonical turns, array<struct<role, text>>, are written as one string: a start marker, the
role, a separator, the text, an end marker for each turn. Control strings inside roles and
texts are escaped by one backslash after their first character, and those escaped already
get one more, so unescaping gives back every text. The loss mask lists the byte spans of
the assistant's texts in the formatted string.

Null texts and roles count as empty strings. Turns are ordered by turn, role, text, so ties
and repeated rows have one order, whatever the input order; all are kept. A null id is a
conversation of its own. An empty table gives no conversations, and a conversation without
turns an empty string. A conversation is one string, so its size bounds a task: no other
group is ever gathered. A table whose own columns fit no mapping raises an error that lists its paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramloom.llm.common import let, running_starts

#: Markers of the format.
START, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
#: First characters and rests of the control strings that are escaped: the markers above and those of other well-known templates.
CONTROL = r"(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
HEAD = r"([<\[])"

TURNS = "array<struct<role:string,text:string>>"

#: Layout: the paths that must be there -> how to read turns. `turns`: list field, role field, text field, names of roles;
#: `fields`: (role, field) in order; a missing or null field makes no turn.
MAPPINGS: list[dict] = [
    {"paths": ["messages[].content", "messages[].role"], "turns": ("messages", "role", "content", {})},
    {"paths": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value", {"human": "user", "gpt": "assistant"})},
    {"paths": ["turns[].speaker", "turns[].text"], "turns": ("turns", "speaker", "text", {"bot": "assistant", "model": "assistant"})},
    {"paths": ["input", "instruction", "output"], "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    {"paths": ["completion", "prompt"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["prompt", "response", "system"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"paths": ["answer", "question"], "fields": [("user", "question"), ("assistant", "answer")]},
    {"paths": ["text"], "fields": [("assistant", "text")]},
]


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a type: a.b, and a[] for what is in a list."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    if isinstance(kind, T.MapType):
        return paths_of(kind.valueType, prefix + "{}")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m["paths"]): m for m in MAPPINGS}
#: Paths that some mapping names.
KNOWN = sorted({p for m in MAPPINGS for p in m["paths"]})


def fingerprint_of(present: dict[str, Column]) -> Column:
    """The fingerprint of each row, from whether it has each of the known paths."""
    there = F.array_compact(F.array(*[F.when(present[p], F.lit(p)) for p in sorted(present)]))
    return F.substring(F.sha2(F.array_join(there, "\n").cast("binary"), 256), 1, 16)


def _selected(layout: str, field: Callable[[dict], Callable[[str], Column]]) -> Column:
    """The turns that the mapping of the fingerprint in column `layout` makes; null if there is none."""
    out = F.lit(None).cast(TURNS)
    for print_, m in BY_FINGERPRINT.items():
        out = F.when(F.col(layout) == print_, _turns(m, field(m))).otherwise(out)
    return out


def _turns(mapping: dict, field: Callable[[str], Column]) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    if "turns" in mapping:
        listed, role, text, names = mapping["turns"]

        def named(r: Column) -> Column:
            out = F.coalesce(r, F.lit(""))
            for a, b in names.items():
                out = F.when(r == a, F.lit(b)).otherwise(out)
            return out

        return F.coalesce(F.transform(field(listed), lambda t: turn(named(t[role]), t[text])), F.array().cast(TURNS))
    made = [F.when(field(f).isNotNull(), turn(F.lit(role), field(f))) for role, f in mapping["fields"]]
    return F.array_compact(F.array(*made))


def canonical_turns(df: DataFrame, id_column: str) -> DataFrame:
    """(id, turns) of a table in one of the known layouts; a null list or field makes no turn."""
    rest = T.StructType([f for f in df.schema.fields if f.name != id_column])
    mapping = BY_FINGERPRINT.get(fingerprint([p for p in paths_of(rest) if p in KNOWN]))
    if mapping is None:
        raise ValueError(f"no mapping for the paths {paths_of(rest)}")
    return df.select(F.col(id_column).alias("id"), _turns(mapping, F.col).alias("turns"))


def canonical_rows(df: DataFrame, id_column: str) -> DataFrame:
    """(id, layout, turns) of a table whose rows differ in layout: a row has the paths of the columns that aren't null in it."""
    fields = {f.name: f for f in df.schema.fields if f.name != id_column}
    present = {p: F.col(f"`{name}`").isNotNull() for name, f in fields.items() for p in paths_of(f.dataType, name) if p in KNOWN}
    printed = df.select("*", fingerprint_of(present).alias("__layout"))
    # a mapping can only be selected where the table has all of its columns
    whole = lambda m: (lambda f: F.col(f"`{f}`")) if set(m["paths"]) <= set(present) else _nothing(m)
    return printed.select(F.col(id_column).alias("id"), F.col("__layout").alias("layout"), _selected("__layout", whole).alias("turns"))


def _nothing(mapping: dict) -> Callable[[str], Column]:
    if "turns" in mapping:
        _, role, text, _ = mapping["turns"]
        return lambda f: F.lit(None).cast(f"array<struct<{role}:string,{text}:string>>")
    return lambda f: F.lit(None).cast("string")


def canonical_records(df: DataFrame, id_column: str, record: str) -> DataFrame:
    """(id, layout, turns) of JSON records whose layouts differ from row to row.

    A record has a path if its object has the field, null or not; a[].b if a is a list of objects of which one has b.
    What is no JSON object has no paths. A record may have as many bytes as Spark allows in a variant.
    """
    parsed = df.select(F.col(id_column).alias("id"), F.expr(f"try_parse_json({record})").alias("doc"))
    opened = parsed.select("*", F.expr("try_variant_get(doc, '$', 'map<string,variant>')").alias("top"))

    def has(path: str) -> Column:
        listed, _, name = path.partition("[].")
        if not name:
            return F.map_contains_key("top", path)
        return F.exists(F.expr(f"try_variant_get(doc, '$.{listed}', 'array<map<string,variant>>')"), lambda m: F.map_contains_key(m, name))

    def read(mapping: dict) -> Callable[[str], Column]:
        kind = "string"
        if "turns" in mapping:
            _, role, text, _ = mapping["turns"]
            kind = f"array<struct<{role}:string,{text}:string>>"
        return lambda f: F.expr(f"try_variant_get(doc, '$.{f}', '{kind}')")

    printed = opened.select("id", "doc", fingerprint_of({p: has(p) for p in KNOWN}).alias("layout"))
    return printed.select("id", "layout", _selected("layout", read).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, HEAD + r"(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, HEAD + r"\\(\\*)" + CONTROL, "$1$2$3")


def format_turns(df: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """(id, turns) to (id, formatted, mask): the string, and the byte spans under the loss."""

    def build(turns: Column) -> Column:
        safe = F.transform(turns, lambda t: F.struct(
            (t["role"] == loss_role).alias("loss"), F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)).alias("head"), escaped(t["text"]).alias("text")))

        def spans(s: Column) -> Column:
            sizes = F.transform(s, lambda t: (F.octet_length(t["head"]) + F.octet_length(t["text"]) + len(END)).cast("bigint"))
            placed = F.zip_with(running_starts(sizes), s, lambda a, t: F.when(t["loss"], F.struct(
                (a + F.octet_length(t["head"])).alias("start"), F.octet_length(t["text"]).cast("bigint").alias("size"))))
            return F.struct(
                F.array_join(F.transform(s, lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"),
                F.filter(placed, lambda p: p.isNotNull()).alias("mask"))

        return let(safe, spans)

    return df.select("id", let(F.col("turns"), build).alias("f")).select("id", "f.formatted", "f.mask")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    whole = F.split(formatted, re.escape(START), -1)
    pieces = F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: let(F.split(p, re.escape(SEP), 2), lambda x: F.struct(
        unescaped(x[0]).alias("role"), unescaped(F.regexp_replace(x[1], re.escape(END) + r"\z", "")).alias("text"))))


def masked_text(formatted: Column, mask: Column) -> Column:
    """What stands under the mask, unescaped span by span, nothing between."""
    return let(F.encode(formatted, "UTF-8"), lambda b: F.array_join(F.transform(
        mask, lambda m: unescaped(F.decode(F.substring(b, (m["start"] + 1).cast("int"), m["size"].cast("int")), "UTF-8"))), ""))


def gather_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn to one row per conversation in the `messages` layout."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def _written(role: str, text: str, names: dict[str, str]) -> Callable[[Column], Column]:
    """A message as a turn of a list layout."""

    def turn(t: Column) -> Column:
        name = t["role"]
        for a, b in names.items():
            name = F.when(t["role"] == a, F.lit(b)).otherwise(name)
        return F.struct(name.alias(role), t["content"].alias(text))

    return turn


def spread_layouts(gathered: DataFrame, id_column: str) -> DataFrame:
    """The `messages` of a table as records of many layouts, chosen by the hash of the id among those that hold a
    conversation as it is: its roles must not be other names of roles in a list layout, and be the layout's own, in
    order, in one of single fields."""
    roles = F.transform("messages", lambda m: m["role"])
    lists, singles = [m for m in MAPPINGS if "turns" in m], [m for m in MAPPINGS if "fields" in m]
    fits = []
    for i, m in enumerate(lists + singles):
        if "turns" in m:
            names = m["turns"][3]
            fit = ~F.arrays_overlap("__roles", F.array(*[F.lit(n) for n in names])) if names else F.lit(True)
        else:
            fit = F.col("__roles") == F.array(*[F.lit(r) for r, _ in m["fields"]])
        fits.append(F.when(fit, F.lit(i)))
    able = gathered.withColumn("__roles", roles).withColumn("__able", F.array_compact(F.array(*fits)))
    at = able.withColumn("__at", F.element_at("__able", (F.pmod(F.xxhash64(id_column), F.size("__able")) + 1).cast("int")))
    columns: dict[str, Column] = {}
    for i, m in enumerate(lists + singles):
        chosen = F.col("__at") == i
        if "turns" in m:
            listed, role, text, names = m["turns"]
            columns[listed] = F.when(chosen, F.transform("messages", _written(role, text, {b: a for a, b in reversed(list(names.items()))})))
        else:
            for k, (_, field) in enumerate(m["fields"]):
                here = F.when(chosen, F.get("messages", F.lit(k))["content"])
                columns[field] = F.coalesce(columns[field], here) if field in columns else here
    return at.select(id_column, *[c.alias(name) for name, c in columns.items()])


def op5_chat_formatting(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Contract view: every conversation and conversation -1, as records of many layouts that their fingerprints bring
    into canonical turns, read back from the formatted strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    made = format_turns(canonical_rows(spread_layouts(gather_messages(rows), "conv_id"), "conv_id"))
    back = made.select("id", "formatted", let(parse_turns(F.col("formatted")), lambda t: F.struct(
        F.size(t).cast("bigint").alias("n"), F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"))).alias("t"),
        masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    return back.select(
        F.col("id").alias("conv_id"), F.col("t.n").alias("n_turns"), F.sha2("t.all", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
