"""Whole analyses: building an index, analysing a log against it, comparing two, and diagnosing a project.

Large tables stay DataFrames; what a report prints is bounded and gathered here."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import joined_lines, neighbours_of
from ..sources import extract, files, profile
from . import compare, events, index, locate, parse, quality, rules


def build_index(spark: SparkSession, root: str, previous: dict[str, DataFrame] | None = None, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """Functions, calls, log sites and file signatures of a source tree; with a previous index only changed files are parsed."""
    now = files.source_files(spark, root, exclude)
    signatures = now.select("file", "signature", "mtime")
    changed = now
    if previous:
        changed_keys, stale = index.changes(now.select("file", "signature"), previous["file_signatures"])
        changed = now.join(changed_keys.select("file"), "file", "left_semi")
    new = extract.index_tables(extract.extract(changed))
    if previous:
        kept = index.without_files({k: previous[k] for k in new}, stale)
        out = index.merged(kept, {**new, "call_edges": new["call_edges"].withColumn("raw", F.col("callee"))})
    else:
        out = {**new, "call_edges": index.resolve_edges(new["call_edges"], new["functions"])}
    return {**out, "file_signatures": signatures}


def analyse(spark: SparkSession, tables: dict[str, DataFrame], lines: DataFrame, manual: dict | None = None, query: str = "", app_only: bool = False, top: int = 3, learned: dict | None = None, context: int = 0) -> dict:
    """Entries, events, candidates and findings of a log, as frames and bounded lists."""
    manual = manual or {}
    known = profile.effective(learned if learned is not None else events.learned_profile(tables["log_sites"]), manual)
    terms = rules.query_terms(query, manual) if query else []
    raw = rules.matching_query(parse.logical_entries(lines, manual.get("app_identifiers") or [], app_only), terms)
    parsed = parse.entries(raw).withColumn("entry_id", F.concat_ws(":", "file", F.col("line_no").cast("string"))).cache()
    ev = events.events(parsed, known).cache()
    found = locate.locate(parsed, tables, max(top, 10) if terms else top).join(parsed.select("entry_id", "raw", "line_no"), "entry_id")
    found = rules.boosted(found, terms, top).cache()
    lined = events.timelines(ev).cache()
    missing = events.missing_events(lined, manual.get("expected_sequences") or {})
    stats = events.duration_stats(ev)
    guesses = rules.hypotheses(ev, missing, stats)
    warnings = rules.profile_warnings(missing, lined)
    rows = lambda df, *order, n=20: [r.asDict(True) for r in df.orderBy(*order).limit(n).collect()]
    counts = {r["type"]: r["n"] for r in events.type_counts(ev).orderBy("first_line").collect()}
    gaps, ideas = rows(missing, F.desc("event_count"), "session_id", "ord"), rows(guesses, "ord", "label")
    report = {
        "counts": {k: tables[k].count() for k in ("functions", "call_edges", "log_sites")}, "entries": parsed.count(), "event_types": counts, "sessions": rows(lined, F.desc("event_count"), "session_id"),
        "top_sessions": [r.asDict() for r in events.top_sessions(ev).collect()], "missing_events": gaps, "durations": rows(stats, F.desc("avg_ms"), "label"), "suggested_rules": [r.asDict() for r in events.suggested_rules(ev).collect()],
        "suspicious": rows(ev.filter(F.col("type").isin(rules.P.SUSPICIOUS)), "line"), "timeline": rows(ev, "line"), "hypotheses": ideas, "profile_warnings": rows(warnings, "session_id", "label"),
        "trace": [r.asDict() for r in rules.evidence_trace(found, missing).collect()], "matches": rows(found, "line_no", "rank"), "query_focus": rows(rules.query_focus(found, terms), "term") if terms else [],
        "diagnosis": rules.diagnosis(spark, counts, gaps, ideas), "query_terms": terms,
    }
    if context:
        suspicious = ev.filter(F.col("type").isin(rules.P.SUSPICIOUS)).select("file", F.col("line").alias("line_no"))
        report["context"] = rows(rules.context_set(lines, suspicious, parsed.join(found.select("entry_id").distinct(), "entry_id").select("file", "line_no"), context), "ord", "file", "line_no")
    return {"report": report, "parsed": parsed, "events": ev, "candidates": found, "timelines": lined, "missing": missing, "durations": stats, "hypotheses": guesses, "warnings": warnings, "profile": known}


def compare_runs(spark: SparkSession, tables: dict[str, DataFrame], baseline: DataFrame, target: DataFrame, manual: dict | None = None) -> dict:
    """What a target log lacks, has besides, and does slower than a baseline."""
    learned = events.learned_profile(tables["log_sites"])
    known = profile.effective(learned, manual or {})
    b, t = (events.events(parse.entries(parse.logical_entries(x)), known).cache() for x in (baseline, target))
    bl, tl = events.timelines(b), events.timelines(t)
    sessions, slow = compare.compare_sessions(bl, tl), compare.duration_anomalies(b, t)
    own = rules.hypotheses(t, events.missing_events(tl, (manual or {}).get("expected_sequences") or {}), events.duration_stats(t))
    guesses = rules.compare_hypotheses(sessions, slow, own)
    labels = compare.compare_labels(bl, tl).first()
    rows = lambda df, *order: [r.asDict(True) for r in df.orderBy(*order).limit(50).collect()]
    return {"labels": labels.asDict(), "sessions": rows(sessions, "rank"), "duration_anomalies": rows(slow, F.desc("ratio"), F.desc("delta_ms")), "hypotheses": rows(guesses, "ord")}


def sequence_from(lined: DataFrame) -> list[str]:
    """The labels of the first timeline that has any, each once, in order."""
    row = lined.filter(F.size("labels") > 0).orderBy(F.desc("event_count"), "session_id").select(F.array_distinct("labels").alias("x")).first()
    return list(row["x"]) if row else []


def source_excerpts(spark: SparkSession, root: str, candidates: DataFrame, reach: int = 3) -> DataFrame:
    """(file, line, excerpt): numbered source lines around each candidate's line, each file read once."""
    wanted = candidates.select("file", F.col("line").alias("line_no")).distinct()
    src = files.source_files(spark, root).join(wanted.select("file").distinct(), "file", "left_semi").select("file", F.decode("content", "utf-8").alias("text"))
    near = neighbours_of(files.log_lines_of(src, "file", "text"), wanted, reach)
    numbered = F.concat(F.col("line_no").cast("string"), F.lit(": "), "line")
    return wanted.withColumnRenamed("line_no", "line").join(joined_lines(near, ["file", "at"], numbered, "excerpt").withColumnRenamed("at", "line"), ["file", "line"], "left")


def doctor(spark: SparkSession, project: str, tables: dict[str, DataFrame] | None, manual: dict) -> dict:
    """Whether a project has an index and a profile, whether the index is stale, and what to do next."""
    newest = files.source_files(spark, project).agg(F.max("mtime")).first()[0]
    indexed = tables["file_signatures"].agg(F.max("mtime")).first()[0] if tables else None
    stale = bool(newest and indexed and newest > indexed)
    advice = []
    if tables is None:
        advice.append("Build an index of the sources.")
    elif stale:
        advice.append("The sources changed after the index was built; build it again.")
    if not manual:
        advice.append("Write a profile, or have one suggested.")
    health = {k: len(manual.get(k) or []) for k in ("app_identifiers", "session_keys", "states", "entities", "events", "expected_sequences")}
    return {"project": str(Path(project)), "app_identifiers": manual.get("app_identifiers") or [], "suggested_app_identifiers": files.app_identifiers(spark, project), "index": tables is not None, "index_stale": stale, "manual_profile": bool(manual), "profile_health": health, "recommendations": advice or ["Nothing to do."]}


def diagnose(spark: SparkSession, project: str, tables: dict[str, DataFrame], lines: DataFrame, manual: dict, query: str = "") -> dict:
    """Doctor, one analysis, and lint over that same analysis."""
    done = analyse(spark, tables, lines, manual, query)
    problems = quality.lint(spark, manual, quality.lines_for(lines, query), done["warnings"]).orderBy("severity", "type", "subject", "item")
    result = {"doctor": doctor(spark, project, tables, manual), "analysis": done["report"], "lint": [r.asDict() for r in problems.collect()], "cleanup_patch": quality.cleanup_patch(problems)}
    return result | {"recommendations": recommended(result)}


def recommended(result: dict) -> list[str]:
    """What to do after a diagnosis, the most urgent first."""
    out = []
    if result["doctor"]["index_stale"]:
        out.append("Build the index again before trusting source locations.")
    places = list(dict.fromkeys(x["subject"] for x in result["analysis"]["trace"] if x["kind"] == "source"))[:3]
    if places:
        out.append(f"Look at {', '.join(places)}.")
    if any(result["cleanup_patch"].values()):
        out.append("Review the cleanup patch, then apply it with profile cleanup.")
    if result["lint"]:
        out.append("Settle the profile's problems before taking missing events for faults.")
    return out or ["Read the evidence; nothing else stands out."]
