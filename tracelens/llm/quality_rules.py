"""Operator 6: line-first cleaning.

Every line with a word is judged by itself: separators of navigation bars, stray signs, shouting, boilerplate
phrases, a missing end mark on a line without any sentence punctuation, and repetition of an earlier line. Failing
lines go; a document that keeps too small a part of its words is rejected. Nulls count as empty texts, which keep
nothing and are rejected. A line repeated in full is judged failed from its second occurrence on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import bytes_of, slices

SIGNS = b"#*$%&|<>"
ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", "\"", "'", ")", "]", "…", "”", "’", "»", "。", "！", "？"))
#: What may stand around a phrase at a line's ends.
EDGES = b" \t\r.,:;!?|*-()[]<>\"'"
#: Fixed phrases of menus, notices and legal lines (lower case).
BOILERPLATE = tuple(
    x.encode()
    for x in (
        "javascript", "lorem ipsum", "cookie policy", "cookies policy", "use of cookies", "uses cookies", "privacy policy", "terms of use",
        "terms of service", "terms and conditions", "all rights reserved", "sign in", "log in", "subscribe to our", "click here", "read more",
        "skip to content", "powered by", "share on", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    )
)


@dataclass(frozen=True)
class Rules:
    """Limits: of the base statistics, of one line, and of the part of the words that must stay."""

    min_words: int = 50
    max_repeat_percent: int = 50
    bar_share: float = 0.2
    sign_share: float = 0.5
    shout_words: int = 3
    boilerplate_words: int = 25
    plain_words: int = 12
    min_kept: float = 0.5


def repeated_words(hashes: np.ndarray, k: int = 3) -> int:
    """Words that lie in a ``k``-word window which the text has at least twice."""
    w = textops.windows(hashes, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w) + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_fails(line: bytes, words: int, rules: Rules) -> str:
    """The rule that a line with ``words`` words breaks, or an empty string."""
    bars = line.count(b"|")
    if bars >= 2 and bars >= rules.bar_share * words:
        return "navigation"
    signs = len(line) - len(line.translate(None, SIGNS))
    if signs > rules.sign_share * words and signs > 2:
        return "signs"
    if words >= rules.shout_words and line.isupper() and not any(c in line for c in b"0123456789"):
        return "shouting"
    if words <= rules.boilerplate_words:
        # a phrase that opens or ends the line, or is most of it; within a sentence it is prose
        low = line.lower().strip(EDGES)
        if any(x in low and (low.startswith(x) or low.endswith(x) or words <= 2 * len(x.split())) for x in BOILERPLATE):
            return "boilerplate"
    if words > rules.plain_words and not line.rstrip().endswith(ENDS) and not any(x in line for x in (b". ", b", ", b"? ", b"! ")):
        return "punctuation"
    return ""


def judge(data: bytes, rules: Rules = Rules()) -> dict:
    """Statistics, clean text and verdict of one text in UTF-8."""
    starts, ends, hashes = textops.word_hashes(data)
    n = len(starts)
    continuation = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)]) if not data.isascii() else None
    chars = int((ends - starts).sum())
    if continuation is not None:
        chars -= int((continuation[ends] - continuation[starts]).sum())
    seen: set[bytes] = set()
    kept, kept_words, duplicates, failed = [], 0, 0, {}
    for line in data.split(b"\n"):
        words = len(line.split())
        if words == 0:
            continue
        if line in seen:
            duplicates += 1
            why = "repeated"
        else:
            seen.add(line)
            why = line_fails(line, words, rules)
        if why:
            failed[why] = failed.get(why, 0) + 1
        else:
            kept.append(line)
            kept_words += words
    repeats = repeated_words(hashes)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SIGNS)), "n_dup_lines": duplicates, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": not base_failed and kept_words >= rules.min_kept * n, "kept_words": kept_words,
        "clean_text": b"\n".join(kept).decode(), "failed_rules": ",".join(f"{k}:{failed[k]}" for k in sorted(failed)),
    }


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "kept_words": pa.int64(), "clean_text": pa.string(), "failed_rules": pa.string(),
}


def clean(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, statistics, ``clean_text``, counts of failed lines by rule, and ``kept``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            out = [judge(x, rules) for x in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in FIELDS.items())], ["id", *FIELDS])

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    schema = ", ".join([f"id {id_type}", *(f"{k} {kinds[v]}" for k, v in FIELDS.items())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
