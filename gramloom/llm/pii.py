"""PII: format-preserving Feistel pseudonyms.

Found and validated values are replaced by a keyed permutation of their own format: card
numbers that pass the Luhn check stay such numbers, North American phone numbers, IPv4
addresses, social security numbers, IBANs (mod 97) and calendar dates stay valid ones,
numbers of a phone's form whose area code or exchange begins with 0 or 1 stay such numbers, and
the letters and digits of a mail address's name and domain are permuted in place. Equal values
get equal pseudonyms in every document, so links between documents survive, and the holder of
the key can invert them.

The permutation is a balanced Feistel network over pairs of residues, whose round function is
keyed BLAKE2b, walked until it lands in the format. Separators, prefixes and letter case are
kept. What fails validation is left as it is.

Null text stays null; text without a match is returned unchanged. Whole texts are read, a row
at a time. Equal rows get equal results. Other columns are kept by pseudonymise() and ignored
by the query. Where two kinds match at one place the first in KINDS wins.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import small_batches

#: Test key; a real run passes its own.
KEY = b"pseudonyms: example key"
ROUNDS = 8
_REST = r"[0-9]{3}[ .-][0-9]{4}"
#: Valid numbers (area code and exchange begin with 2-9), then any digits where +1, parentheses or separators show the form;
#: by separators alone not where another group of four follows, as in a card number.
PHONE = (
    r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?!\w)"
    rf"|(?:\+?1[ .-]?)?\([0-9]{{3}}\) ?{_REST}|\+1[ .-]?[0-9]{{3}}[ .-]{_REST}|(?:1[ .-])?[0-9]{{3}}[ .-]{_REST}(?![ -][0-9]{{4}}(?![0-9])))(?!\w)"
)
#: Patterns of the kinds, in order of precedence.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "phone": PHONE,
    "card": r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.\w)",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.\w)",
}
FOUND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Some character that any match holds.
HINT = re.compile(r"[0-9@]")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
DATE_FORMS = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}


def permute(x: int, size: int, key: bytes, tweak: str, *, valid: Callable[[int], bool] = lambda _: True, invert: bool = False) -> int:
    """The keyed permutation of the valid numbers below size, at the valid number x."""
    a = math.isqrt(size - 1) + 1 if size > 1 else 1

    def f(i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{half}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        left, right = divmod(x, a)
        for i in range(ROUNDS - 1, -1, -1) if invert else range(ROUNDS):
            left, right = ((right - f(i, left)) % a, left) if invert else (right, (left + f(i, right)) % a)
        x = left * a + right
        if x < size and valid(x):
            return x


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _put_back(form: str, digits: str) -> str:
    """The digits in the places of a value's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _spell(value: str, key: bytes, tweak: str, invert: bool) -> str:
    """Lower-case letters, capitals and digits of a string permuted, each as one number in its own radix."""
    out = list(value)
    for name, chars in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")):
        at = [i for i, c in enumerate(value) if c in chars]
        if at:
            n = 0
            for i in at:
                n = n * len(chars) + chars.index(value[i])
            n = permute(n, len(chars) ** len(at), key, f"{tweak}{name}", invert=invert)
            for i in reversed(at):
                n, r = divmod(n, len(chars))
                out[i] = chars[r]
    return "".join(out)


def _mail(v: str, key: bytes, invert: bool) -> str:
    name, _, domain = v.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_spell(name, key, 'mail', invert)}@{_spell(host, key, 'host', invert)}.{top}"


def _card(v: str, key: bytes, invert: bool) -> str | None:
    d = re.sub("[^0-9]", "", v)
    if not luhn(d) or len(set(d)) == 1:
        return None
    # the issuer's first digit stays; the last one is the check
    n = permute(int(d[1:-1]), 10 ** (len(d) - 2), key, "card" + d[0], invert=invert)
    body = d[0] + str(n).zfill(len(d) - 2)
    return _put_back(v, next(body + c for c in "0123456789" if luhn(body + c)))


def _phone(v: str, key: bytes, invert: bool) -> str:
    d = re.sub("[^0-9]", "", v)
    body = d[-10:]
    ok = lambda n: (s := str(n).zfill(10))[0] > "1" and s[3] > "1"
    # valid numbers among themselves, and so are the others
    like = ok(int(body))
    return _put_back(v, d[:-10] + str(permute(int(body), 10**10, key, "phone", valid=lambda n: ok(n) == like, invert=invert)).zfill(10))


def _ssn(v: str, key: bytes, invert: bool) -> str | None:
    ok = lambda n: (s := str(n).zfill(9))[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    n = int(v.replace("-", ""))
    return _put_back(v, str(permute(n, 10**9, key, "ssn", valid=ok, invert=invert)).zfill(9)) if ok(n) else None


def _ip(v: str, key: bytes, invert: bool) -> str | None:
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", invert=invert)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _iban(v: str, key: bytes, invert: bool) -> str | None:
    s = v.replace(" ", "")
    as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or as_number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _spell(s[4:], key, "iban" + s[:2], invert)
    check = 98 - as_number(body + s[:2] + "00") % 97
    it = iter(f"{s[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in v)


def _date(v: str, key: bytes, invert: bool) -> str | None:
    form = DATE_FORMS[re.sub("[0-9]", "", v)[0]]
    try:
        day = datetime.datetime.strptime(v, form).date().toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(day, DAYS, key, "date", invert=invert)).strftime(form)


MAPS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _mail, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date}


@lru_cache(maxsize=1 << 14)
def pseudonym(kind: str, value: str, key: bytes, invert: bool = False) -> str | None:
    """The value's pseudonym, or None where the value isn't valid."""
    return MAPS[kind](value, key, invert)


def replace_all(text: str, key: bytes = KEY, invert: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the given text."""
    spans: list[tuple[str, int, int]] = []
    if not HINT.search(text):
        return text, spans
    out, last, at = [], 0, 0
    while m := FOUND.search(text, at):
        new = pseudonym(m.lastgroup, m.group(), key, invert)
        if new is None:
            # what isn't valid as one kind may hold another one further on
            nxt = TOKEN.match(text, m.start())
            at = nxt.end() if nxt else m.start() + 1
            continue
        out += [text[last : m.start()], new]
        spans.append((m.lastgroup, m.start(), m.end()))
        last = at = m.end()
    return ("".join([*out, text[last:]]) if spans else text), spans


def pseudonymise(documents: DataFrame, *, key: bytes = KEY, invert: bool = False) -> DataFrame:
    """documents with pseudonyms in `text`, and a last column pii_spans: "kind:start:end" of each, comma-joined."""
    small_batches(documents.sparkSession)
    names = documents.columns
    at = names.index("text")
    rest = [i for i in range(len(names)) if i != at]
    # numbered names, so that no column of the input can clash with another
    sent = documents.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(sent.schema.fields)) + ", spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for x in b.column(at):
                t = x.as_py()
                new, found = replace_all(t, key, invert) if t is not None else (None, [])
                texts.append(new)
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
            cols: list = [None] * len(names)
            for i in rest:
                cols[i] = b.column(i)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.string())], [f"c{i}" for i in range(len(names))] + ["spans"])

    return sent.mapInArrow(run, schema).toDF(*names, "pii_spans")


def op10_pii_pseudonyms(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of which kinds were replaced."""
    done = pseudonymise(documents.select("doc_id", "text"))
    return done.select("doc_id", "text", F.when(F.col("pii_spans") == "", 0).otherwise(F.size(F.split("pii_spans", ","))).cast("bigint").alias("n_pii"), "pii_spans")
