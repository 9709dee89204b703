"""Operator 8: personal data, with offset-preserving deobfuscation.

Four base kinds are found in the text as it stands, each from left to right without overlap. Then transducers
rewrite disguises: look-alike characters, invisible characters, spelled digits, and words or brackets for "at" and
"dot". Each character of the rewritten text knows the stretch of source characters it stands for, so what the same
detectors find there maps back to the source. Found stretches that a base span of the same kind does not already
hold are added. Nulls count as empty texts, repeated rows give repeated rows. Offsets are code points, ends exclusive.
The counts by kind are of base spans only; what the transducers add stands in the spans alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Fixed look-alikes of Latin letters and signs: Cyrillic, Greek, then marks.
LOOKALIKES = dict(
    zip(
        "авеѕіјкмнорсԁһтухгԛԝАВЕЅІЈКМНОРСТУХ" "αβγεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɡɑⅼ" "‐‑‒–—―−﹘﹣" "․。｡﹒" "﹫" "﹢",
        "abesijkmhopcdhtyxrqwABESIJKMHOPCTYX" "abyeiknoptuxABEZHIKMNOPTYX" "igal" "---------" "...." "@" "+",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿᠎‎‏"
STRANGE = re.compile(r"[^\x00-ɏḀ-ỿ‘-•…€]|­|ı|[‐-―]| ")
#: Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_number = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_at = r"(?:at|arroba|arobase|ät)"
_dot = r"(?:dot|punto|punkt|point|dt)"
_open, _close = r"[\[({<]", r"[\])}>]"
_word = r"[A-Za-z0-9-]+"
_dotted = rf"(?:\s*{_open}\s*{_dot}\s*{_close}\s*|\s+{_dot}\s+|\s*\.\s*|_{_dot}_)"
REWRITE = re.compile(
    rf"(?P<spelled>(?<!\w){_number}(?:(?:\s+|\s?-\s?|,\s?){_number})*(?!\w))"
    rf"|(?P<plus>(?<!\w)plus\s+(?=(?:{_number}(?!\w)|[0-9])))"
    rf"|(?P<at>\s*{_open}\s*(?:{_at}|@)\s*{_close}\s*|(?<=[A-Za-z0-9])(?:\s+{_at}\s+|_{_at}_)(?={_word}(?:\s*{_open}\s*{_dot}\s*{_close}|\s+{_dot}\s|_{_dot}_))|(?<=\w)\s+@\s*(?=\w)|(?<=\w)@\s+(?={_word}{_dotted}\w))"
    rf"|(?P<dot>\s*{_open}\s*(?:{_dot}|\.)\s*{_close}\s*|(?<=[A-Za-z0-9])(?:\s+{_dot}\s+|_{_dot}_)(?=\w))",
    re.I,
)
BRACKETED = re.compile(rf"{_open}\s*(?:{_at}|{_dot}|@|\.)\s*{_close}|\s@|@\s")
SAID = re.compile(rf"[a-z0-9](?:\s+{_dot}\s+|_{_dot}_)\w")
COUNTED = re.compile(rf"(?<!\w){_number}\W{{1,3}}(?:{_number}(?!\w)|[0-9])|[0-9]\W{{1,3}}{_number}(?!\w)")
DOT_WORDS = frozenset(_dot[3:-1].split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, sorted by start and then by kind as listed; linear in the text."""
    spans = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            spans.append((start, last := m.end(), "email"))
        at = text.find("@", max(at + 1, last))
    ip_end = card_end = 0
    for m in DIGITS.finditer(text):
        s = m.start()
        if s >= ip_end and (x := IP.match(text, s)):
            ip_end = x.end()
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in x[0].split(".")):
                spans.append((s, ip_end, "ip"))
        if s >= card_end and (x := CARD.match(text, s)):
            card_end = x.end()
            digits = x[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((s, card_end, "card"))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((at, m.end(), "phone"))
        at = text.find("+", m.end() if m else at + 1)
    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return spans


def plain(c: str) -> str:
    """What a single character stands for: a look-alike's Latin letter, an ASCII compatibility form, or itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if c.isspace() and c not in "\n\r":
        return " "
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) <= 4 else c


def rewrite(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises, and for each of its characters the start and end of its source."""
    chars, begin, end = [], [], []
    for i, c in enumerate(text):
        for x in c if c < "\u0080" else plain(c):
            chars.append(x)
            begin.append(i)
            end.append(i + 1)
    middle = "".join(chars)
    out, b, e, last = [], [], [], 0
    for m in REWRITE.finditer(middle):
        i, j = m.span()
        kind = m.lastgroup
        new = "@" if kind == "at" else "." if kind == "dot" else "+" if kind == "plus" else None
        if new is None:
            words = re.findall(_number, m[0], re.I)
            new = "".join(SPELLED[w.lower()] for w in words)
        out += (middle[last:i], new)
        b += begin[last:i]
        e += end[last:i]
        if kind == "spelled":  # each digit keeps the place of its word
            at = i
            for w in words:
                at = middle.index(w, at)
                b.append(begin[at])
                e.append(end[at + len(w) - 1])
                at += len(w)
        else:
            b += [begin[i]] * len(new)
            e += [end[j - 1]] * len(new)
        last = j
    out.append(middle[last:])
    return "".join(out), b + begin[last:], e + end[last:]


def disguised(text: str) -> bool:
    """Whether any transducer could change the text; a cheap look first, a regular expression only where it passes."""
    if not text.isascii() and STRANGE.search(text):
        return True
    low = text.lower()
    if any(c in low for c in "@[({<") and BRACKETED.search(low):
        return True
    words = set(low.replace("-", " ").replace(",", " ").replace("_", " ").split())
    if not DOT_WORDS.isdisjoint(words) and SAID.search(low):
        return True
    return not SPELLED.keys().isdisjoint(words) and COUNTED.search(low) is not None


def hidden(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the rewritten text shows."""
    if not disguised(text):
        return []
    new, begin, end = rewrite(text)
    added = []
    for s, e, kind in find(new):
        a, z = begin[s], end[e - 1]
        known = [(x, y) for x, y, k in base if k == kind and x < z and a < y]
        if text[a:z] == new[s:e] or known and (kind != "email" or any(x <= a and z <= y for x, y in known)):
            continue  # a number's base span isn't stretched over the word beside it
        added.append((a, z, kind))
    return added


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = find(text)
    return base, sorted({*base, *hidden(text, base)}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder for each span; overlapping ones share the first's."""
    out, last = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= last:
            out += (text[last:s], f"<{kind.upper()}>")
        last = max(last, e)
    return "".join([*out, text[last:]])


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per row of ``df``: the id, ``base_spans`` and ``spans`` (written as kind:start:end, comma-joined), counts of base spans by kind and, if asked for, ``redacted`` text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            texts = texts_of(batch, "text")
            found = [spans_of(t) for t in texts]
            columns = [batch.column(0), *(pa.array([sum(x[2] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS)]
            columns += [pa.array([written(x[i]) for x in found], pa.string()) for i in (0, 1)]
            if redacted:
                columns.append(pa.array([redact(t, x[1]) if x[1] else t for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", *["redacted"] * redacted]
    schema = ", ".join([f"id {id_type}", *(f"n_{k} bigint" for k in KINDS), *(f"{x} string" for x in names[5:])])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a placeholder for each span in ``text_col``; a null text stays null."""
    at = df.columns.index(text_col)

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            texts = [t if not t else redact(t, spans_of(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))

    return df.mapInArrow(work, df.schema)
