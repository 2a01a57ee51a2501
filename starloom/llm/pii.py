"""Operator 6: personal data.

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod 97 for IBANs, octet ranges for addresses), and words standing near a span
raise or lower its score. Spans of the four base kinds that pass their
validator are always kept; the additional kinds are kept from ``MIN_SCORE`` on.

Kinds, in the order in which they are listed
    email  ip  card  phone          base kinds, see :func:`base_spans`
    iban                            country, check digits, mod 97
    card_short                      13 to 15 digits passing Luhn, with context
    phone_local                     number without +, with context

Offsets are code points, end exclusive. Defined results for odd input: null
text is read as empty and has no spans; texts of any length are searched whole
in time linear in their length; overlapping spans of different kinds are all
reported and redacted once, as the kind listed first; repeated rows each get
their own result; an empty table gives an empty one; extra columns are kept
whatever their names, a new column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import free_name, short_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card_short", "phone_local")
MIN_SCORE = 0.7
#: Characters on either side in which context words count.
CONTEXT = 48

LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start inside a run of digits only if it also matches from the run's start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
IBAN_BODY = re.compile(r"(?: ?[A-Z0-9]){11,30}+")
PHONE_LOCAL = re.compile(r"(?<![0-9+.(-])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Characters of an account number by country (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words near a span that speak for its kind (first) or against any (second).
CONTEXT_WORDS = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|bank|bic|swift|cuenta|compte)\b"),
    "card_short": re.compile(r"(?i)\b(?:card|credit|visa|amex|mastercard|karte|kreditkarte|tarjeta|carte)\b"),
    "phone_local": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|anruf|tel[eé]fono|t[eé]l[eé]phone|reach)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|serial|example)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str):
    """Spans of account numbers: of the country's length, or of any length where the country is unknown, that pass mod 97."""
    for head in IBAN.finditer(text):
        body = IBAN_BODY.match(text, head.end())
        if not body:
            continue
        ends, count = {}, 4  # characters without spaces -> end
        for at in range(body.start(), body.end()):
            if text[at] != " ":
                count += 1
                ends[count] = at + 1
        known = IBAN_LENGTH.get(head[1])
        for n in [known] if known else sorted(ends, reverse=True):
            end = ends.get(n)
            if end and not text[end : end + 1].isalnum() and mod97(text[head.start() : end]):
                yield head.start(), end
                break


def emails(text: str):
    """Leftmost non-overlapping addresses, walking from one @ to the next."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            floor = tail.end()
        else:
            floor = at + 1  # no local part can hold the @ itself
        at = text.find("@", max(floor, at + 1))


def phones(text: str):
    at = text.find("+")
    while at >= 0:
        found = PHONE.match(text, at)
        if found:
            end = found.end()
            while not text[end - 1].isdigit() or not text[end - 1].isascii():
                end -= 1
            if end - at >= 4:  # plus, a digit, one from the class, a last digit
                yield at, end
                at = end - 1
        at = text.find("+", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds that pass their validator, by kind and start."""
    found = [("email", *s) for s in emails(text)]
    if not any_digit(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    digits = []
    for m in DIGITS.finditer(text):
        if 16 <= m.end() - m.start():
            bare = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(bare) <= 19 and luhn(bare):
                digits.append(("card", *m.span()))
    found += digits
    for start, end in phones(text):
        n = sum(c in "0123456789" for c in text[start:end])
        if 8 <= n <= 15:
            found.append(("phone", start, end))
    return found


DIGIT = re.compile("[0-9]")


def any_digit(text: str) -> bool:
    return DIGIT.search(text) is not None


def near(text: str, start: int, end: int) -> str:
    return text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]


def added_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of the additional kinds with their scores."""
    if not any_digit(text):
        return []
    found = []

    def propose(kind: str, start: int, end: int, score: float) -> None:
        around = near(text, start, end)
        score += 0.4 * bool(CONTEXT_WORDS[kind].search(around)) - 0.3 * bool(AGAINST.search(around))
        if score >= MIN_SCORE:
            found.append((kind, start, end, round(score, 2)))

    for start, end in ibans(text):
        propose("iban", start, end, 0.9)
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            bare = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(bare) <= 15 and luhn(bare):
                propose("card_short", *m.span(), 0.4)
    for m in PHONE_LOCAL.finditer(text):
        propose("phone_local", *m.span(), 0.35)
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of ``text`` with scores, by kind as in ``KINDS``, then start."""
    text = text or ""
    return [*((k, s, e, 1.0) for k, s, e in base_spans(text)), *added_spans(text)]


def spell(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact(text: str | None, spans=None) -> str | None:
    """The text with each span replaced by its kind in angle brackets."""
    if text is None:
        return None
    spans = find_spans(text) if spans is None else spans
    rank = {k: i for i, k in enumerate(KINDS)}
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], rank[s[0]])):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{kind.upper()}>" if start >= at else ""]
        at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``spans`` (array of kind, start, end, score) and ``redacted``."""
    short_batches(docs.sparkSession)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    added = [T.StructField(free_name("spans", docs.columns), T.ArrayType(span)), T.StructField(free_name("redacted", docs.columns), T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_col)

    def search(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(at).to_pylist():
                found = find_spans(text)
                spans.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in found])
                clean.append(redact(text, found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind), pa.array(clean, pa.string())], names=schema.names)

    return docs.mapInArrow(search, schema)


def pii_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of base kinds and the digests of its spans."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(F.col("doc_id").alias(id_col), *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


def digest_of(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(spell(base_spans(text or "")).encode()).hexdigest()
