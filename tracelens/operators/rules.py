"""Findings drawn from events, timelines, durations and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.frames import joined_lines, neighbours_of
from ..functions.text import shorten

#: Words that carry no query by themselves are shorter than two characters.
QUERY_WORD = r"([A-Za-z0-9_一-鿿]{2,})"


def hypotheses(ev: DataFrame, missing: DataFrame, stats: DataFrame) -> DataFrame:
    """(ord, title, confidence, evidence): a missing step beside a timeout, repeated retries, an exception, long stages."""
    counts = ev.agg(F.count_if(F.col("type") == "timeout").alias("timeouts"), F.count_if(F.col("type") == "retry").alias("retries"), F.count_if(F.col("type") == "exception").alias("exceptions"))
    lacks = missing.agg(F.count(F.lit(1)).alias("m"))
    row = lambda df, n, title, c, said: df.select(F.lit(n).alias("ord"), F.lit("").alias("label"), F.lit(title).alias("title"), F.lit(c).alias("confidence"), said.cast("string").alias("evidence"))
    parts = [
        row(counts.crossJoin(lacks).filter("m > 0 and timeouts > 0"), 1, "Expected event missing before a timeout", 0.82, F.col("m")),
        row(counts.filter("retries >= 2"), 2, "Repeated retries", 0.68, F.col("retries")),
        row(counts.filter("exceptions > 0"), 3, "Exception", 0.74, F.col("exceptions")),
        stats.filter("max_ms >= 10000").select(F.lit(4).alias("ord"), "label", F.lit("Long-running stage").alias("title"), F.lit(0.62).alias("confidence"), F.col("max_ms").cast("bigint").cast("string").alias("evidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def compare_hypotheses(sessions: DataFrame, anomalies: DataFrame, target: DataFrame) -> DataFrame:
    """The first session that lacks steps and ends in a timeout, the worst slow-down, and the target's first three."""
    first = sessions.filter((F.size("missing") > 0) & F.array_contains("target_labels", "timeout")).orderBy("rank").limit(1)
    slow = anomalies.orderBy(F.desc("ratio"), F.desc("delta_ms"), "label").limit(1)
    own = target.orderBy("ord", "label").limit(3)
    return (
        first.select(F.lit(1).alias("ord"), F.col("target_session").alias("label"), F.lit("Target session lacks baseline events and times out").alias("title"), F.lit(0.84).alias("confidence"))
        .unionAll(slow.select(F.lit(2), "label", F.lit("Duration regression"), F.lit(0.78)))
        .unionAll(own.select(F.col("ord") + 2, "label", "title", "confidence"))
    )


def profile_warnings(missing: DataFrame, lines: DataFrame) -> DataFrame:
    """(type, session_id, sequence, label) for each missing label: seen in another session only, or nowhere."""
    seen = lines.select(F.explode("labels").alias("label"), F.col("session_id").alias("s")).groupBy("label").agg(F.count_distinct("s").alias("sessions"))
    each = missing.select("session_id", "sequence", "observed", F.explode(F.array_distinct("missing")).alias("label")).join(seen, "label", "left")
    here = F.array_contains("observed", F.col("label"))
    elsewhere = F.coalesce("sessions", F.lit(0)) - here.cast("int")
    kind = F.when(~here & (elsewhere > 0), F.lit("sequence_session_mismatch")).when(F.coalesce("sessions", F.lit(0)) == 0, F.lit("sequence_unobserved_event"))
    return each.select(kind.alias("type"), "session_id", "sequence", "label").filter("type is not null").distinct()


def query_terms(query: str, profile: dict | None = None) -> list[str]:
    """Words of a query with the profile's other names for the same thing, sorted."""
    import re

    terms = set(re.findall(QUERY_WORD, query.lower()))
    groups = [[name, *(spec.get("aliases") or [] if isinstance(spec, dict) else [])] for name, spec in ((profile or {}).get("entities") or {}).items()]
    groups += [[name, *(spec.get("patterns") or [] if isinstance(spec, dict) else [])] for name, spec in ((profile or {}).get("events") or {}).items()]
    low = query.lower()
    for names in groups:
        lowered = [str(n).lower() for n in names if str(n)]
        if any(n in terms or n in low for n in lowered):
            terms |= set(lowered)
    return sorted(terms)


def matching_query(entries: DataFrame, terms: list[str]) -> DataFrame:
    """Entries whose text holds any term; all of them without terms."""
    return entries.filter(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("raw"), t))) if terms else entries


def boosted(found: DataFrame, terms: list[str], top: int) -> DataFrame:
    """Candidates (with ``raw``) with points for each query term they or their entry hold, ranked anew and cut to ``top``."""
    if terms:
        hay = F.lower(F.concat_ws(" ", "raw", "function", "file", F.array_join("reasons", " ")))
        hits = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t)))
        found = found.withColumn("score", F.col("score") + P.QUERY_TERM * hits)
    w = Window.partitionBy("entry_id").orderBy(F.desc("score"), "file", "line", "function_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def query_focus(found: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n): how many entries each term occurs in."""
    return found.select("entry_id", F.explode(F.array(*map(F.lit, terms))).alias("term"), F.lower("raw").alias("r")).filter(F.contains(F.col("r"), F.col("term"))).groupBy("term").agg(F.count_distinct("entry_id").alias("n"))


def context_windows(lines: DataFrame, around: DataFrame, reach: int) -> DataFrame:
    """(file, line_no, context): the lines up to ``reach`` before and after each line of ``around``."""
    return joined_lines(neighbours_of(lines, around, reach), ["file", "at"], "line", "context").withColumnRenamed("at", "line_no")


def context_set(lines: DataFrame, suspicious: DataFrame, matches: DataFrame, reach: int, most: int = 10) -> DataFrame:
    """(ord, file, line_no, context): contexts of the first suspicious events, then of the first matches, each line once."""
    first = lambda df, n: df.select("file", "line_no").distinct().orderBy("file", "line_no").limit(most).withColumn("ord", F.lit(n))
    chosen = first(suspicious, 0).unionAll(first(matches, 1)).groupBy("file", "line_no").agg(F.min("ord").alias("ord"))
    return context_windows(lines, chosen, reach).join(chosen, ["file", "line_no"]).select("ord", "file", "line_no", "context")


def best_detail(raw: Column) -> Column:
    """The last line of an entry that is neither blank nor a box border, trimmed of the box; empty if there is none."""
    said = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[│|]", ""))), lambda x: (x != "") & ~x.rlike("^[┌└├─]"))
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))


def top_sources(found: DataFrame, limit: int = 5) -> DataFrame:
    """The best candidate of each function with the first entry that names it."""
    w = Window.partitionBy("function_id").orderBy(F.desc("score"), "line_no", "rank")
    first = Window.partitionBy("function_id").orderBy("line_no", "rank")
    out = found.withColumn("n", F.row_number().over(w)).withColumn("first_log", F.first(shorten(F.col("raw"))).over(first)).filter("n = 1")
    return out.orderBy(F.desc("score"), "line_no", "function_id").limit(limit)


def evidence_trace(found: DataFrame, missing: DataFrame, limit: int = 5) -> DataFrame:
    """(kind, subject, detail): the best sources with their first matching log line, then what is missing."""
    best = top_sources(found, limit).select(F.lit("source").alias("kind"), F.concat_ws(":", "file", F.col("line").cast("string"), "function").alias("subject"), F.col("first_log").alias("detail"))
    gaps = missing.orderBy(F.desc("event_count"), "session_id", "ord").limit(3)
    return best.unionAll(gaps.select(F.lit("missing"), "session_id", F.concat_ws(": ", "sequence", F.array_join("missing", ", "))))


def diagnosis(spark: SparkSession, counts: dict[str, int], missing: list, guesses: list) -> dict:
    """The summary line and findings of an analysis, from small gathered tables."""
    findings = [f"{n} {kind} event(s)" for kind, n in counts.items() if kind in P.SUSPICIOUS]
    absent = [x for m in missing for x in m["missing"]]
    if absent:
        summary = f"Expected events are missing: {', '.join(dict.fromkeys(absent))}"
    elif guesses:
        summary = guesses[0]["title"]
    elif findings:
        summary = "Suspicious events were found: " + ", ".join(findings)
    else:
        summary = "No suspicious runtime event was found"
    return {"summary": summary, "findings": findings, "missing_events": list(dict.fromkeys(absent))}
