"""Queries of rules, context, query focus, audits and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import events as E
from ..operators import locate as L
from ..operators import quality as Q
from ..operators import rules
from . import rendered as R
from .analysis import RUNS_SQL, events, renamed, split_runs
from .evidence import TOTAL_SQL, entries


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = R.lines(spark, d)
    around = events(spark, d).filter("type = 'timeout'").select("file", F.col("line").alias("line_no"))
    return rules.context_windows(lines, around, 2).select("line_no", F.md5(F.col("context").cast("binary")).alias("context"))


CONTEXT_SQL = f"""with {R.LINES_SQL}, w as (select line_no, type, string_agg(line, chr(10)) over (order by line_no rows between 2 preceding and 2 following) as c from parsed)
select line_no, md5(c) as context from w where type = 'timeout'"""


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    missing = E.missing_events(E.timelines(ev), {"flow": ["duration", "unseen"]})
    return rules.hypotheses(ev, missing, E.duration_stats(ev)).select("label", "title", "confidence", "evidence")


HYPOTHESES_SQL = f"""with {R.LINES_SQL}, c as (select count(*) filter (type = 'timeout') as t, count(*) filter (type = 'retry') as r from parsed),
m as (select count(distinct session_id) as m from parsed where type = 'duration')
select '' as label, 'Expected event missing before a timeout' as title, 0.82::double as confidence, cast(m as varchar) as evidence from c, m where m > 0 and t > 0
union all select '', 'Repeated retries', 0.68, cast(r as varchar) from c where r >= 2
union all select case when state <> '' then state else type end, 'Long-running stage', 0.62, cast(max(ms) as varchar) from parsed group by 1 having max(ms) >= 10000"""


def compare_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    b, t = split_runs(spark, d)
    t = renamed(t, "retry", "again")
    sessions = C.compare_sessions(E.timelines(b), E.timelines(t))
    own = rules.hypotheses(t, E.missing_events(E.timelines(t), {"flow": ["nothing"]}), E.duration_stats(t))
    return rules.compare_hypotheses(sessions, C.duration_anomalies(b, t), own).select("label", "title", "confidence")


COMPARE_SQL = f"""with {RUNS_SQL}, r2 as (select *, case when side = 't' and type = 'retry' then 'again' else type end as label from runs),
t2 as (select side, session_id, count(*) as n, list(label order by line_no) as labels from r2 group by side, session_id),
b as (select session_id, labels, row_number() over (order by n desc, session_id) as r from t2 where side = 'b'), t as (select session_id, labels, row_number() over (order by n desc, session_id) as r from t2 where side = 't'),
p as (select b.r, b.labels as bl, coalesce(i.session_id, k.session_id, '') as ts, coalesce(i.labels, k.labels, []) as tl from b left join t i on i.session_id = b.session_id left join t k on k.r = b.r),
f as (select ts from p where len(list_filter(bl, lambda x: not list_contains(tl, x))) > 0 and list_contains(tl, 'timeout') order by r limit 1),
s as (select side, case when state <> '' then state else label end as label, avg(run_ms) as a, max(run_ms) as m from r2 group by 1, 2),
a as (select t.label from s t join s b on t.label = b.label and t.side = 't' and b.side = 'b' where t.a / b.a >= 2 and t.a - b.a >= 500 order by t.a / b.a desc limit 1),
h as (select * from (select 2 as o, '' as label, 'Repeated retries' as title, 0.68::double as c from r2 where side = 't' and type = 'retry' having count(*) >= 2
  union all select 4, label, 'Long-running stage', 0.62 from s where side = 't' and m >= 10000) order by o, label limit 3)
select ts as label, 'Target session lacks baseline events and times out' as title, 0.84::double as confidence from f union all select label, 'Duration regression', 0.78 from a union all select label, title, c from h"""


def profile_warnings(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    t = E.timelines(ev.withColumn("label", F.when((F.col("label") == "timeout") & (F.col("line") % 2 == 0), F.lit("late")).otherwise(F.col("label"))))
    return rules.profile_warnings(E.missing_events(t, {"flow": ["state", "timeout", "never"]}), t)


WARNINGS_SQL = f"""with {R.LINES_SQL}, k as (select session_id, line_no, case when type = 'timeout' and line_no % 2 = 0 then 'late' else type end as label from parsed), s as (select session_id, list(label order by line_no) as l from k group by session_id having list_contains(list(label), 'state')),
m as (select session_id, l, not list_contains(l[list_position(l, 'state') + 1:], 'timeout') as t from s), n as (select count(distinct session_id) as c from k where label = 'timeout')
select 'sequence_unobserved_event' as type, session_id, 'flow' as sequence, 'never' as label from m
union all select case when c > 0 then 'sequence_session_mismatch' else 'sequence_unobserved_event' end, session_id, 'flow', 'timeout' from m, n where t and not list_contains(l, 'timeout')"""


def query_filter_boost(spark: SparkSession, d: str) -> DataFrame:
    profile = {"entities": {"purchase": {"aliases": ["order"]}}}
    terms = rules.query_terms("Purchase committed!", profile)
    kept = rules.matching_query(entries(spark, d), terms)
    found = L.locate(kept, R.index(spark), 10).join(kept.select("entry_id", "raw"), "entry_id")
    out = rules.boosted(found, terms, 1)
    return out.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("total"))


#: The best candidate of each line that holds a term, by its evidence and twelve points a term.
BOOST_SQL = f"""with {R.LINES_SQL}, {R.INDEX_SQL}, {TOTAL_SQL}, terms as (select unnest(['purchase', 'committed', 'order']) as term),
kept as (select line_no, lower(line) as low from parsed where exists (select 1 from terms where contains(lower(line), term))),
hay as (select t.line_no, t.function_id, t.score, coalesce(t.line, f.start_line) as site_line, f.file, k.low || ' ' || lower(f.qualname || ' ' || f.file || ' ' || coalesce(t.reason, '')) as h from total t join kept k using (line_no) join functions f on f.id = t.function_id),
sums as (select *, score + 12 * (select count(*) from terms where contains(h, term)) as boosted from hay),
best as (select *, row_number() over (partition by line_no order by boosted desc, file, site_line, function_id) as rank from sums)
select function_id, count(*) as n, cast(sum(boosted) as bigint) as total from best where rank = 1 group by function_id"""


def part_sites(spark: SparkSession, d: str) -> DataFrame:
    """Part names and types as log templates of varying level."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " sessionId=%s").when(k % 4 == 1, " took %d ms").when(k % 4 == 2, " status {} reason {}").otherwise(" %d")
    template = F.when(k % 50 == 7, F.lit("%d {}")).otherwise(F.concat("p_name", tail))
    return p.select(k.alias("id"), template.alias("template"), F.when(k % 3 == 0, "error").otherwise("info").alias("level"))


PART_SITES_SQL = """sites as (select p_partkey as id, case when p_partkey % 50 = 7 then '%d {}' else p_name || case p_partkey % 4 when 0 then ' sessionId=%s' when 1 then ' took %d ms' when 2 then ' status {} reason {}' else ' %d' end end as template,
  case when p_partkey % 3 = 0 then 'error' else 'info' end as level from part),
audit as (select count(*) as log_sites, count(*) filter (regexp_matches(template, '(?i)\\b(?:traceId|requestId|reqId|deliveryId|orderId|taskId|sessionId|sid|uuid|sn)\\b\\s*[=:]|\\{[^}]*id[^}]*\\}|%[sd]')) as with_session_key,
  count(*) filter (regexp_matches(template, '(?i)\\b(duration|elapsed|cost|took)\\b')) as with_duration, count(*) filter (regexp_matches(template, '(?i)\\b(state|status)\\b|Await|Pending|Success|Failed|Timeout')) as with_state,
  count(*) filter (level = 'error') as error_log_sites, count(*) filter (level = 'error' and regexp_matches(template, '(?i)\\b(exception|throwable|errorCode|code|reason|cause|stack)\\b')) as error_with_detail,
  count(*) filter (not regexp_matches(template, '[A-Za-z]{3,}')) as generic from sites)"""


def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Q.audit(part_sites(spark, d))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_score(Q.audit(part_sites(spark, d))).select("score", "log_sites")


SCORE_SQL = f"""with {PART_SITES_SQL} select cast(greatest(0, least(100, 40 + floor(25 * with_session_key / log_sites) + floor(15 * with_duration / log_sites) + floor(10 * with_state / log_sites)
  + floor(10 * error_with_detail / error_log_sites) - least(20, 2 * generic))) as integer) as score, log_sites from audit"""

PROFILE = {
    "session_keys": ["sessionId", "orderId", "handleIncomingRequest"],
    "entities": {"Order": {"aliases": ["order", "data"]}},
    "events": {"committed": {"type": "commit", "patterns": ["order committed"]}, "odd": {"patterns": ["never seen"]}, "bare": {"patterns": []}, "plain": "text", "vague": {"patterns": ["message", "clicked item"]}},
    "expected_sequences": {"flow": ["committed", "shipped"], "broken": "committed"},
}


def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = R.lines(spark, d)
    hits = Q.pattern_hits(lines, Q.profile_tables(spark, PROFILE)).select(F.col("event").alias("name"), "hits")
    keys = Q.key_hits(lines, PROFILE["session_keys"]).select(F.col("key").alias("name"), "hits")
    return hits.unionAll(keys)


LINT_SQL = f"""with {R.LINES_SQL} select 'committed' as name, count(*) filter (event_type = 'purchase') as hits from parsed union all select 'odd', 0 union all select 'bare', 0
union all select 'vague', count(*) filter (event_type = 'click') from parsed union all select 'sessionId', count(*) from parsed union all select 'orderId', 0 union all select 'handleIncomingRequest', 0"""


def lint_problems(spark: SparkSession, d: str) -> DataFrame:
    return Q.lint(spark, PROFILE, R.lines(spark, d))


PROBLEMS_SQL = f"""with {R.LINES_SQL}, patterns as (select * from (values ('committed', 'order committed'), ('odd', 'never seen'), ('bare', null), ('vague', 'message'), ('vague', 'clicked item')) as p(event, pattern)),
hits as (select event, sum((select count(*) from parsed where contains(lower(line), pattern))) as n from patterns group by event),
keys as (select key, (select count(*) from parsed where contains(line, key || '=')) as n from (values ('sessionId'), ('orderId'), ('handleIncomingRequest')) as k(key))
select 'warning' as severity, 'unmatched_event' as type, event as subject, '' as item from hits where coalesce(n, 0) = 0 union all select 'info', 'unused_session_key', key, '' from keys where n = 0
union all select * from (values ('warning', 'suspicious_session_key', 'handleIncomingRequest', ''), ('warning', 'generic_alias', 'Order', 'data'), ('warning', 'invalid_event', 'plain', ''), ('warning', 'empty_event', 'bare', ''),
('warning', 'generic_event_pattern', 'vague', 'message'), ('warning', 'invalid_sequence', 'broken', ''), ('warning', 'undefined_sequence_event', 'flow', 'shipped')) as t(severity, type, subject, item)"""


def extract_python_sites(spark: SparkSession, d: str) -> DataFrame:
    """Functions, calls and log sites of generated Python sources, one file per supplier."""
    from ..sources import extract

    s = spark.read.parquet(f"{d}/supplier.parquet")
    n = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("import logging\nlog = logging.getLogger()\nclass Store:\n    def save"), n, F.lit("(self, x):\n        log.info('saved %s for supplier "), n, F.lit("', x)\n        return load(x)\n\ndef load(x):\n    log.error(f'bad {x}')\n"))
    files = s.select(F.concat(F.lit("supplier"), n, F.lit(".py")).alias("file"), F.concat(F.lit("supplier"), n).alias("module"), F.lit("python").alias("language"), F.encode(code, "utf-8").alias("content"))
    rows = extract.extract(files)
    return rows.select("kind", "file", "name", F.col("line").cast("bigint").alias("line"), "template", "level")


EXTRACT_SQL = """with s as (select 'supplier' || s_suppkey as m, s_suppkey as k from supplier)
select 'function' as kind, m || '.py' as file, 'Store.save' || k as name, 4 as line, '' as template, '' as level from s union all select 'function', m || '.py', 'load', 8, '', '' from s
union all select 'call', m || '.py', 'log.info', 5, '', '' from s union all select 'call', m || '.py', 'load', 6, '', '' from s union all select 'call', m || '.py', 'log.error', 9, '', '' from s
union all select 'site', m || '.py', 'Store.save' || k, 5, 'saved %s for supplier ' || k, 'info' from s union all select 'site', m || '.py', 'load', 9, 'bad {}', 'error' from s"""
EXTRACT_SQL = EXTRACT_SQL.replace("4 as line", "cast(4 as bigint) as line")

QUERIES = {
    "context_windows": (context_windows, CONTEXT_SQL),
    "hypotheses": (hypotheses, HYPOTHESES_SQL),
    "compare_hypotheses": (compare_hypotheses, COMPARE_SQL),
    "profile_warnings": (profile_warnings, WARNINGS_SQL),
    "query_filter_boost": (query_filter_boost, BOOST_SQL),
    "audit_metrics": (audit_metrics, f"with {PART_SITES_SQL} select * from audit"),
    "quality_score": (quality_score, SCORE_SQL),
    "lint_counts": (lint_counts, LINT_SQL),
    "lint_problems": (lint_problems, PROBLEMS_SQL),
    "extract_python_sites": (extract_python_sites, EXTRACT_SQL),
}
