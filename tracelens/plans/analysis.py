"""Queries of event classification, sessions, durations, vocabulary and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import reused
from ..operators import compare as C
from ..operators import events as E
from . import rendered as R
from .parsing import parsed

EXPECTED = {"flow": ["state", "duration", "retry", "state", "timeout", "duration"]}


def events(spark: SparkSession, d: str) -> DataFrame:
    return reused(E.events(parsed(spark, d)))


def event_types(spark: SparkSession, d: str) -> DataFrame:
    return E.type_counts(events(spark, d))


def session_extract(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("line", "session_key", "session_id")


def state_extract(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("line", "state")


def duration_extract(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("line", F.col("duration_ms").cast("bigint").alias("ms"))


def event_evidence(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("line", F.array_join("evidence", " ").alias("evidence"))


EVIDENCE_SQL = f"""with {R.LINES_SQL}, g as (select *, case when ms >= 1000000 then null else cast(ms as varchar) end as t from parsed)
select line_no as line, 'duration_ms=' || t || case when state <> '' then ' state=' || state else '' end || ' sessionId=' || session_id as evidence from g"""


def session_timelines(spark: SparkSession, d: str) -> DataFrame:
    t = E.timelines(events(spark, d))
    return t.select("session_id", "event_count", F.array_join("labels", ">").alias("labels"), F.array_join(F.transform(F.map_entries("event_types"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("event_types"))


TIMELINES_SQL = f"""with {R.LINES_SQL}, a as (select session_id, count(*) as event_count, string_agg(type, '>' order by line_no) as labels from parsed group by session_id),
b as (select session_id, string_agg(type || '=' || n, ',' order by type) as event_types from (select session_id, type, count(*) as n from parsed group by all) group by session_id) select * from a join b using (session_id)"""


def session_top10(spark: SparkSession, d: str) -> DataFrame:
    return E.top_sessions(events(spark, d))


def missing_events(spark: SparkSession, d: str) -> DataFrame:
    m = E.missing_events(E.timelines(events(spark, d)), {"flow": ["duration", "retry", "state", "timeout"] * 20})
    return m.select("session_id", "sequence", F.array_join("missing", ">").alias("missing"))


#: The greedy walk as a recursive query over the positions of labels.
MISSING_SQL = f"""with recursive {R.LINES_SQL}, t as (select session_id, list(type order by line_no) as labels from parsed group by session_id having list_contains(list(type), 'duration')),
s as (select flatten(list_resize([['duration', 'retry', 'state', 'timeout']], 20, ['duration', 'retry', 'state', 'timeout'])) as expected),
walk(session_id, labels, k, cur, absent) as (select session_id, labels, 1, 0, cast([] as varchar[]) from t
  union all select session_id, labels, k + 1, case when p > 0 then cur + p else cur end, case when p > 0 then absent else list_append(absent, x) end
  from (select w.*, s.expected[k] as x, coalesce(list_position(labels[cur + 1:], s.expected[k]), 0) as p from walk w, s where k <= 80))
select session_id, 'flow' as sequence, array_to_string(absent, '>') as missing from walk where k = 81 and len(absent) > 0"""


def sequence_labels(spark: SparkSession, d: str) -> DataFrame:
    t = E.timelines(events(spark, d))
    return t.select("session_id", F.array_join(F.array_distinct("labels"), ">").alias("labels"))


SEQUENCE_SQL = f"with {R.LINES_SQL} select session_id, string_agg(type, '>' order by f) as labels from (select session_id, type, min(line_no) as f from parsed group by all) group by session_id"


def duration_stats(spark: SparkSession, d: str) -> DataFrame:
    s = E.duration_stats(events(spark, d))
    return s.select("label", "count", F.col("min_ms").cast("bigint").alias("min_ms"), F.col("max_ms").cast("bigint").alias("max_ms"), F.round("avg_ms", 6).alias("avg_ms"))


STATS_SQL = f"with {R.LINES_SQL} select case when state <> '' then state else type end as label, count(*) as count, min(ms) as min_ms, max(ms) as max_ms, round(avg(ms), 6) as avg_ms from parsed group by 1"


def suggested_rules(spark: SparkSession, d: str) -> DataFrame:
    return E.suggested_rules(events(spark, d))


SUGGEST_SQL = rf"""with {R.LINES_SQL}, w as (select line_no, message, session_id, unnest(regexp_extract_all(lower(regexp_replace(message, '\b\d+\b', ' ', 'g')), '[a-z][a-z0-9_-]{{2,}}')) as pattern,
  generate_subscripts(regexp_extract_all(lower(regexp_replace(message, '\b\d+\b', ' ', 'g')), '[a-z][a-z0-9_-]{{2,}}'), 1) as pos from parsed),
c as (select pattern, count(*) as count, min(line_no * 1000 + pos) as seen, arg_min(message, line_no * 1000 + pos) as example from w
  where pattern not in ('error', 'failed', 'failure', 'timeout', 'retry', 'state', 'status', 'http', 'post', 'get') and pattern <> session_id group by pattern order by 2 desc, 3 limit 8)
select pattern, count, example from c where count >= 2"""


def learned_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    sites = p.select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_type").alias("template"))
    return E.vocabulary(sites).select("pattern", "type", "count", "log_sites", "example")


VOCABULARY_SQL = r"""with s as (select p_partkey as ord, p_name || ' ' || p_type as template from part),
w as (select ord, template, unnest(regexp_extract_all(lower(regexp_replace(template, '%\w|\{[^}]*\}|\b\d+\b|0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}', ' ', 'g')), '[a-z][a-z0-9_-]{2,}')) as pattern,
  generate_subscripts(regexp_extract_all(lower(regexp_replace(template, '%\w|\{[^}]*\}|\b\d+\b|0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}', ' ', 'g')), '[a-z][a-z0-9_-]{2,}'), 1) as pos from s),
c as (select pattern, count(*) as count, count(distinct ord) as log_sites, min(ord * 1000 + pos) as seen, arg_min(template, ord * 1000 + pos) as example from w
  where pattern not in ('the','and','for','with','from','this','that','http','https','post','get','put','delete','error','failed','failure','timeout','retry','state','status','info','debug','warn','warning','null','true','false','log','logger')
  group by pattern order by 2 desc, 4 limit 80)
select pattern, 'project:' || pattern as type, count, log_sites, example from c"""


def split_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of the earlier and the later half of the lines; in the later one, durations of the state Loaded are tripled."""
    ev = events(spark, d)
    n = R.events(spark, d).agg((F.max("event_id") / 2).cast("bigint").alias("half"))
    both = ev.crossJoin(F.broadcast(n))  # one row
    late = both.filter("line > half").withColumn("duration_ms", F.when(F.col("state") == "Loaded", F.col("duration_ms") * 3 + 1000).otherwise(F.col("duration_ms")))
    return both.filter("line <= half").drop("half"), late.drop("half")


RUNS_SQL = f"""{R.LINES_SQL}, half as (select cast(floor(max(event_id) / 2) as bigint) as h from events),
runs as (select *, case when line_no <= h then 'b' else 't' end as side, case when line_no > h and state = 'Loaded' then ms * 3 + 1000 else ms end as run_ms from parsed, half),
tl as (select side, session_id, count(*) as n, list(type order by line_no) as labels from runs group by all)"""


def renamed(ev: DataFrame, label: str, new: str) -> DataFrame:
    """Events with another name for one label, so that two runs differ."""
    return ev.withColumn("label", F.when(F.col("label") == label, F.lit(new)).otherwise(F.col("label")))


def compare_labels(spark: SparkSession, d: str) -> DataFrame:
    b, t = split_runs(spark, d)
    out = C.compare_labels(E.timelines(renamed(b, "timeout", "lapse")), E.timelines(renamed(t, "retry", "again")))
    digest = lambda c: F.md5(F.array_join(c, ">").cast("binary"))
    return out.select(digest("shared").alias("shared"), digest("missing").alias("missing"), digest("extra").alias("extra"), F.size("missing").cast("bigint").alias("n_missing"))


COMPARE_LABELS_SQL = f"""with {RUNS_SQL}, kept as (select *, case when side = 'b' and type = 'timeout' then 'lapse' when side = 't' and type = 'retry' then 'again' else type end as label from runs),
k as (select side, session_id, count(*) as n, list(label order by line_no) as labels from kept group by side, session_id),
f as (select flatten(list(labels order by n desc, session_id) filter (side = 'b')) as b, flatten(list(labels order by n desc, session_id) filter (side = 't')) as t from k)
select md5(array_to_string(list_filter(b, lambda x: list_contains(t, x)), '>')) as shared, md5(array_to_string(list_filter(b, lambda x: not list_contains(t, x)), '>')) as missing,
  md5(array_to_string(list_filter(t, lambda x: not list_contains(b, x)), '>')) as extra, len(list_filter(b, lambda x: not list_contains(t, x))) as n_missing from f"""


def compare_sessions(spark: SparkSession, d: str) -> DataFrame:
    b, t = split_runs(spark, d)
    moved = t.withColumn("session_id", F.when(F.col("session_id").endswith("7"), F.concat("session_id", F.lit("x"))).otherwise(F.col("session_id")))
    out = C.compare_sessions(E.timelines(b), E.timelines(moved))
    flat = lambda c: F.array_join(c, ">")
    return out.select("baseline_session", "target_session", flat("missing").alias("missing"), flat("extra").alias("extra"), F.size("shared").cast("bigint").alias("n_shared"))


COMPARE_SESSIONS_SQL = f"""with {RUNS_SQL}, b as (select session_id, labels, row_number() over (order by n desc, session_id) as r from tl where side = 'b'),
moved as (select case when session_id like '%7' then session_id || 'x' else session_id end as session_id, n, labels from tl where side = 't'),
t as (select session_id, labels, row_number() over (order by n desc, session_id) as r from moved),
p as (select b.session_id as bs, b.labels as bl, coalesce(i.session_id, k.session_id, '') as ts, coalesce(i.labels, k.labels, []) as tl from b left join t i on i.session_id = b.session_id left join t k on k.r = b.r),
a as (select * from p union all select '', [], t.session_id, t.labels from t where t.session_id not in (select ts from p))
select bs as baseline_session, ts as target_session, array_to_string(list_filter(bl, lambda x: not list_contains(tl, x)), '>') as missing, array_to_string(list_filter(tl, lambda x: not list_contains(bl, x)), '>') as extra,
  cast(len(list_filter(bl, lambda x: list_contains(tl, x))) as bigint) as n_shared from a"""


def duration_anomalies(spark: SparkSession, d: str) -> DataFrame:
    out = C.duration_anomalies(*split_runs(spark, d))
    return out.select("label", *(F.round(c, 4).alias(c) for c in ("baseline_avg_ms", "target_avg_ms", "ratio", "delta_ms")))


ANOMALY_SQL = f"""with {RUNS_SQL}, s as (select side, case when state <> '' then state else type end as label, avg(run_ms) as a from runs group by all)
select t.label, round(b.a, 4) as baseline_avg_ms, round(t.a, 4) as target_avg_ms, round(t.a / b.a, 4) as ratio, round(t.a - b.a, 4) as delta_ms
from s t join s b on t.label = b.label and t.side = 't' and b.side = 'b' where b.a > 0 and t.a / b.a >= 2 and t.a - b.a >= 500"""


def ordered_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Ordered union of each user's and the next user's event types."""
    ev = R.events(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    other = ev.select((F.col("user_id") - 1).alias("user_id"), F.col("types").alias("more"))
    return ev.join(other, "user_id").select("user_id", F.array_join(F.array_distinct(F.concat("types", "more")), ">").alias("types"))


UNION_SQL = """with e as (select user_id, event_id, event_type from events), b as (select user_id, event_type, 0 as s, event_id from e union all select user_id - 1, event_type, 1, event_id from e),
f as (select user_id, event_type, min(s * 1000000000 + event_id) as o, max(s) as m, min(s) as n from b group by all)
select user_id, string_agg(event_type, '>' order by o) as types from f group by user_id having max(m) = 1 and min(n) = 0"""

QUERIES = {
    "event_types": (event_types, f"with {R.LINES_SQL} select type, count(*) as n, min(line_no) as first_line from parsed group by type"),
    "session_extract": (session_extract, f"with {R.LINES_SQL} select line_no as line, 'sessionId' as session_key, session_id from parsed"),
    "state_extract": (state_extract, f"with {R.LINES_SQL} select line_no as line, state from parsed"),
    "duration_extract": (duration_extract, f"with {R.LINES_SQL} select line_no as line, ms from parsed"),
    "event_evidence": (event_evidence, EVIDENCE_SQL),
    "session_timelines": (session_timelines, TIMELINES_SQL),
    "session_top10": (session_top10, f"with {R.LINES_SQL} select session_id, count(*) as n, min(line_no) as first_line from parsed group by 1 order by 2 desc, 3 limit 10"),
    "missing_events": (missing_events, MISSING_SQL),
    "sequence_labels": (sequence_labels, SEQUENCE_SQL),
    "duration_stats": (duration_stats, STATS_SQL),
    "suggested_rules": (suggested_rules, SUGGEST_SQL),
    "learned_vocabulary": (learned_vocabulary, VOCABULARY_SQL),
    "compare_labels": (compare_labels, COMPARE_LABELS_SQL),
    "compare_sessions": (compare_sessions, COMPARE_SESSIONS_SQL),
    "duration_anomalies": (duration_anomalies, ANOMALY_SQL),
    "ordered_distinct_union": (ordered_distinct_union, UNION_SQL),
}
