"""Column functions on log messages and templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once: later filters and expressions don't repeat what stands below."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def normalize(x: Column | str) -> Column:
    """White space collapsed to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def group(x: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(x, pattern, n)


def canonical(x: Column | str) -> Column:
    """Lower-case form in which ids, numbers and placeholders look alike."""
    x = F.lower(normalize(x))
    for pattern, new in ((r"\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", " <uuid> "), (r"(?U)\b\d+\b", " <num> "), (r"%[sdrfioxX]", " <var> "), (r"\{[^}]*\}", " <var> ")):
        x = F.regexp_replace(x, pattern, new)
    return normalize(x)


def quick_similarity(a: Column, b: Column) -> Column:
    """Similarity of canonical forms where a cheap rule decides it, else null."""
    la, lb = F.length(a), F.length(b)
    ratio = F.least(la, lb) / F.greatest(la, lb)
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    overlap = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.95))
        .when(ratio < 0.4, F.lit(0.0))
        .when(overlap > 0.8, 0.85 + (overlap - 0.8) * 0.5)
    )


@F.pandas_udf(T.DoubleType())
def matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two strings, in this order; only pairs that no cheap rule decides come here."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def template_regex(template: str) -> str:
    """A pattern that finds a logger template in a message: placeholders match anything, white space any white space."""
    text = " ".join(str(template or "").split())
    if not text:
        return ""
    parts = []
    for m in re.finditer(r"%[sdrfioxX]|\{[^}]*\}|(.)", text):
        parts.append(".+?" if m[1] is None else r"\s+" if m[1] == " " else re.escape(m[1]))
    return "(?s)" + "".join(parts)


@F.pandas_udf(T.StringType())
def template_regex_udf(templates: pd.Series) -> pd.Series:
    return templates.map(template_regex)


def keywords(template: Column) -> Column:
    """Words of four letters or more in a template."""
    return F.array_distinct(F.regexp_extract_all(F.lower(template), F.lit("([A-Za-z一-鿿]{4,})"), F.lit(1)))


def message_keywords(message: Column) -> Column:
    """White-space separated words of a message of four characters or more, letters and digits only."""
    words = F.split(F.lower(normalize(message)), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike(r"^[\p{L}\p{N}]+$")))


def is_generic(template: Column) -> Column:
    """No literal word is left beside the placeholders."""
    return ~F.regexp_replace(template, P.FORMAT_TOKEN, " ").rlike(P.LITERAL_WORD)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def same_file(indexed: Column, given: Column) -> Column:
    """Equal base names, or the indexed path ends with the given one."""
    return (given != "") & ((file_name(indexed) == file_name(given)) | F.endswith(indexed, given))


def shorten(x: Column, limit: int = 180) -> Column:
    x = normalize(x)
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("…"))).otherwise(x)


def number_text(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g writes it."""
    exponent = F.floor(F.log10(F.abs(x)) + F.lit(1e-12)).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(x, 6)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", x / F.pow(F.lit(10.0), exponent)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    # between: keep six significant digits in all
    scale = F.pow(F.lit(10.0), 5 - exponent)
    rounded = F.round(x * scale) / scale
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").when((exponent >= 6) | (exponent < -4), scientific).when(F.abs(x) >= 1, fixed).otherwise(F.coalesce(fixed, plain))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``, case folded; none for an empty part."""
    low, p = F.lower(text), F.lower(part)
    return F.when(part == "", F.lit(0)).otherwise(((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).cast("int"))
