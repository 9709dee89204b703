"""Auditing log templates, linting and refining a project profile; small results, gathered by the caller where rendered."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import normalize, occurrences
from .events import quoted, words


def audit(sites: DataFrame) -> DataFrame:
    """One row of counts over log templates, in one pass."""
    t = F.col("template")
    error = F.lower(F.coalesce("level", F.lit(""))).isin("error", "fatal", "critical", "exception")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return sites.agg(
        F.count(F.lit(1)).alias("log_sites"), count(t.rlike(P.AUDIT_SESSION)).alias("with_session_key"), count(t.rlike(P.AUDIT_DURATION)).alias("with_duration"),
        count(t.rlike(P.AUDIT_STATE)).alias("with_state"), count(error).alias("error_log_sites"), count(error & t.rlike(P.AUDIT_DETAIL)).alias("error_with_detail"),
        count(~normalize(t).rlike(P.LITERAL_WORD)).alias("generic"),
    )


def quality_score(counts: DataFrame) -> DataFrame:
    """Adds ``score``: 0 to 100 from the shares of templates with keys, durations, states and error details."""
    c = F.col
    share = lambda part, whole, points: F.floor(points * c(part) / F.nullif(c(whole), F.lit(0))).cast("int")
    detail = F.when(c("error_log_sites") > 0, share("error_with_detail", "error_log_sites", 10)).otherwise(5)
    total = 40 + share("with_session_key", "log_sites", 25) + share("with_duration", "log_sites", 15) + share("with_state", "log_sites", 10) + detail - F.least(F.lit(20), c("generic") * 2)
    return counts.withColumn("score", F.when(c("log_sites") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int"))


def audit_problems(counts: DataFrame) -> DataFrame:
    """(ord, problem) of an audit row."""
    c = F.col
    rules = [
        ((c("log_sites") > 0) & (c("with_session_key") / F.nullif(c("log_sites"), F.lit(0)) < 0.5), "Fewer than half of the log templates carry a session or request key."),
        ((c("log_sites") > 0) & (c("with_duration") / F.nullif(c("log_sites"), F.lit(0)) < 0.2), "Few log templates carry a duration."),
        ((c("error_log_sites") > 0) & (c("error_with_detail") / F.nullif(c("error_log_sites"), F.lit(0)) < 0.5), "Many error templates lack a cause."),
        (c("generic") > 0, "Some log templates are too generic to be matched."),
    ]
    rows = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(text).alias("problem"))) for i, (test, text) in enumerate(rules)])
    return counts.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def suspicious_key(key: Column) -> Column:
    """A session key that looks like a function's name."""
    return key.rlike("[a-z][A-Z]") & (F.length(key) > 14)


def generic_token(token: Column) -> Column:
    low = F.lower(F.trim(token))
    return low.isin(P.GENERIC_TOKENS) | (low.rlike(r"^[\x00-\x7f]*$") & (F.length(low) <= 2))


def profile_tables(spark: SparkSession, profile: dict) -> dict[str, DataFrame]:
    """A profile's lists as small tables: keys, aliases, events, patterns, steps."""
    events = profile.get("events") or {}
    rows = {
        "keys": ([(i, str(k)) for i, k in enumerate(profile.get("session_keys") or [])], "ord int, key string"),
        "aliases": ([(e, str(a)) for e, s in (profile.get("entities") or {}).items() for a in (s.get("aliases") or [] if isinstance(s, dict) else [])], "entity string, alias string"),
        "events": ([(n, str((s.get("type") or "") if isinstance(s, dict) else ""), isinstance(s, dict)) for n, s in events.items()], "event string, type string, valid boolean"),
        "patterns": ([(n, i, str(p)) for n, s in events.items() if isinstance(s, dict) for i, p in enumerate(s.get("patterns") or [])], "event string, ord int, pattern string"),
        "sequences": ([(n, isinstance(s, list)) for n, s in (profile.get("expected_sequences") or {}).items()], "sequence string, valid boolean"),
        "steps": ([(n, i, str(x)) for n, s in (profile.get("expected_sequences") or {}).items() if isinstance(s, list) for i, x in enumerate(s)], "sequence string, ord int, label string"),
    }
    return {k: spark.createDataFrame(r, schema) for k, (r, schema) in rows.items()}


def pattern_hits(lines: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(event, hits): occurrences of each valid event's patterns in a log."""
    patterns = tables["patterns"].filter("pattern <> ''").agg(F.collect_list(F.struct("event", "pattern")).alias("p"))  # as long as the profile
    hits = lines.crossJoin(F.broadcast(patterns)).select(F.inline(F.transform("p", lambda x: F.struct(x["event"].alias("event"), occurrences(F.col("line"), x["pattern"]).alias("hits")))))
    counted = hits.groupBy("event").agg(F.sum("hits").cast("bigint").alias("hits"))
    return tables["events"].filter("valid").select("event").join(counted, "event", "left").select("event", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def key_hits(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(key, hits): how often each session key is followed by a value; case matters."""
    counts = [F.sum(F.regexp_count("line", F.lit(rf"\b{quoted(k)}\b\s*[=:]"))).alias(f"k{i}") for i, k in enumerate(keys)]
    if not keys:
        return lines.sparkSession.createDataFrame([], "key string, hits bigint")
    row = lines.agg(*counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(f"k{i}"), F.lit(0)).cast("bigint").alias("hits")) for i, k in enumerate(keys)])))


def lines_for(lines: DataFrame, query: str) -> DataFrame:
    """Lines that hold any word of a query; all lines if none does."""
    terms = re.findall(r"[a-z0-9_\u4e00-\u9fff-]{2,}", (query or "").lower())
    if not terms:
        return lines
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("line"), t))
    marked = lines.withColumn("__hit", hit)
    some = marked.agg(F.coalesce(F.max("__hit"), F.lit(False)).alias("__some"))
    return marked.crossJoin(F.broadcast(some)).filter("__hit or not __some").drop("__hit", "__some")  # one row


def lint(spark: SparkSession, profile: dict, lines: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """(severity, type, subject, item) of a profile's weaknesses, and with a log those that it shows."""
    t = profile_tables(spark, profile)
    found = lambda df, severity, kind, subject, item="": df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.col(subject).alias("subject"), (F.col(item) if item else F.lit("")).alias("item"))
    known = t["events"].select(F.col("event").alias("label")).unionAll(t["events"].filter("type <> ''").select("type"))
    parts = [
        found(t["keys"].filter(suspicious_key(F.col("key"))), "warning", "suspicious_session_key", "key"),
        found(t["aliases"].filter(generic_token(F.col("alias"))), "warning", "generic_alias", "entity", "alias"),
        found(t["events"].filter("not valid"), "warning", "invalid_event", "event"),
        found(t["events"].filter("valid").join(t["patterns"], "event", "left_anti"), "warning", "empty_event", "event"),
        found(t["patterns"].filter(generic_token(F.col("pattern"))), "warning", "generic_event_pattern", "event", "pattern"),
        found(t["sequences"].filter("not valid"), "warning", "invalid_sequence", "sequence"),
        found(t["steps"].join(known, "label", "left_anti"), "warning", "undefined_sequence_event", "sequence", "label"),
    ]
    if lines is not None:
        hits = pattern_hits(lines, t)
        parts.append(found(hits.filter("hits = 0"), "warning", "unmatched_event", "event"))
        parts.append(found(key_hits(lines, [str(k) for k in profile.get("session_keys") or []]).filter("hits = 0"), "info", "unused_session_key", "key"))
        if warnings is not None:
            # an event that the log's text shows but no session does is a mismatch of sessions
            shown = hits.filter("hits > 0").select(F.col("event").alias("label"), F.lit(True).alias("shown"))
            w = warnings.join(shown, "label", "left").withColumn("type", F.when((F.col("type") == "sequence_unobserved_event") & F.coalesce("shown", F.lit(False)), "sequence_session_mismatch").otherwise(F.col("type")))
            parts.append(w.select(F.lit("warning").alias("severity"), "type", F.col("sequence").alias("subject"), F.col("label").alias("item")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


#: What to do about templates that an audit finds wanting, and where it finds nothing.
ADVICE = [
    "Name the request or session in every log line of a flow.", "Log how long a step took where it ends or times out.",
    "Say in error logs which exception, reason or code it was.", "Word templates so that they tell one event from another.",
]
KEEP_UP = ["Keep keys, states and durations alike across events that belong together."]


def recommendations(problems: list[str]) -> list[str]:
    """Advice that goes with the problems of an audit."""
    return ADVICE if problems else KEEP_UP


def fixes(problems: list[dict]) -> list[dict]:
    """(action, target, reason) for each problem of a lint that has a remedy, each once."""
    out = {}
    for p in problems:
        if p["type"] in REASONS:
            out.setdefault((ACTIONS[p["type"]], p["item"] or p["subject"]), REASONS[p["type"]])
    return [{"action": a, "target": t, "reason": r} for (a, t), r in out.items()]


#: Why each remedy is proposed.
REASONS = {
    "unused_session_key": "This log doesn't show it; remove it only if no log does.", "suspicious_session_key": "It reads like a function's name, not like a field.",
    "generic_event_pattern": "It matches lines that have nothing to do with the event.", "generic_alias": "It matches lines that have nothing to do with the entity.",
    "unmatched_event": "None of its patterns occurs in this log.", "sequence_session_mismatch": "The event occurs, but in another session; split the sequence or log a common key.",
    "undefined_sequence_event": "The profile defines no event of this name.",
}


#: What to do about each kind of finding.
ACTIONS = {
    "suspicious_session_key": "remove_session_key", "generic_alias": "narrow_alias", "empty_event": "remove_event", "invalid_event": "remove_event",
    "generic_event_pattern": "narrow_pattern", "undefined_sequence_event": "define_event", "unmatched_event": "review_event", "unused_session_key": "review_session_key",
    "sequence_session_mismatch": "split_sequence",
}


def cleanup_patch(problems: DataFrame) -> dict[str, list[str]]:
    """Lists of what to remove and what to review, from the problems of a lint (as many as the profile has items)."""
    target = F.create_map(*[F.lit(x) for kv in {
        "suspicious_session_key": "remove_session_keys", "empty_event": "remove_events", "invalid_event": "remove_events", "unused_session_key": "review_session_keys",
        "unmatched_event": "review_events", "sequence_session_mismatch": "review_sequences", "undefined_sequence_event": "review_sequences",
    }.items() for x in kv])
    rows = problems.withColumn("target", F.try_element_at(target, "type")).filter("target is not null").groupBy("target").agg(F.array_sort(F.collect_set("subject")).alias("items")).collect()
    out: dict[str, list[str]] = {k: [] for k in ("remove_session_keys", "remove_events", "review_session_keys", "review_events", "review_sequences")}
    return out | {r["target"]: r["items"] for r in rows}


def cleaned(profile: dict, patch: dict) -> dict:
    """A profile without the session keys and events that a patch removes; nothing else of it applies."""
    out = {k: v for k, v in profile.items()}
    out["session_keys"] = [k for k in profile.get("session_keys") or [] if str(k) not in set(patch.get("remove_session_keys") or [])]
    out["events"] = {k: v for k, v in (profile.get("events") or {}).items() if k not in set(patch.get("remove_events") or [])}
    return out


def runtime_tokens(ev: DataFrame, limit: int = 30) -> DataFrame:
    """(pattern, example): words of suspicious and early events, each once, in order of appearance."""
    each = ev.select("line", "message", "session_id", F.posexplode(words(F.col("message"), P.TEMPLATE_BLANKED)).alias("pos", "pattern"))
    each = each.filter(~F.col("pattern").isin(P.REFINE_STOP) & (F.col("pattern") != F.lower("session_id")))
    first = each.groupBy("pattern").agg(F.min(F.struct("line", "pos", "message")).alias("seen"))
    return first.orderBy("seen.line", "seen.pos").limit(limit).select("pattern", F.col("seen.message").alias("example"))
