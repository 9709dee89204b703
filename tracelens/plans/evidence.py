"""Queries of template matching, evidence stages and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.frames import reused
from ..operators import index as ix
from ..operators import locate as L
from . import rendered as R
from .parsing import parsed


def entries(spark: SparkSession, d: str) -> DataFrame:
    return reused(parsed(spark, d).withColumn("entry_id", F.col("line_no").cast("string")))


def template_match_join(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("entry_id", F.col("message").alias("msg"), T.normalize("message").alias("norm")).withColumn("msg_id", F.md5("msg"))
    index = R.index(spark)
    s = L.sites_with_keywords(index["log_sites"], index["functions"])
    messages = e.select("msg_id", "norm").dropDuplicates(["msg_id"])
    pairs = L.candidate_pairs(messages, s).join(messages, "msg_id").join(s.select("site_id", "regex"), "site_id").filter(F.expr("norm rlike regex"))
    return e.join(pairs.select("msg_id", "site_id"), "msg_id").groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


SITE_TESTS = {"log:1": "event_type = 'error'", "log:2": "event_type = 'signup'", "log:3": "event_type = 'purchase'", "log:4": "event_type = 'view'", "log:5": "event_type = 'click'"}
MATCH_SQL = f"with {R.LINES_SQL} " + " union all ".join(f"select '{k}' as site_id, count(*) as n from parsed where {v} having count(*) > 0" for k, v in SITE_TESTS.items())


def template_keyword_prefilter(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("line_no", T.normalize("message").alias("norm")).withColumn("msg_id", F.col("line_no"))
    index = R.index(spark)
    s = L.sites_with_keywords(index["log_sites"], index["functions"])
    return L.candidate_pairs(e, s).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


PREFILTER_SQL = f"""with {R.LINES_SQL}, {R.INDEX_SQL},
w as (select line_no, list_filter(string_split(lower(message), ' '), lambda x: length(x) >= 4 and regexp_full_match(x, '[a-z0-9]+')) as mk from parsed),
k as (select id as site_id, list_distinct(regexp_extract_all(lower(template), '[a-z]{{4,}}')) as sk from sites)
select site_id, count(*) as n from w, k where len(mk) = 0 or list_has_any(mk, sk) group by site_id"""


def canonical_similarity_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("line_no", T.canonical("message").alias("b"))
    sims = e.withColumn("a", F.lit("order committed sessionid=s<num> soon")).withColumn("sim", T.quick_similarity(F.col("a"), F.col("b")))
    return sims.groupBy(F.coalesce(F.round("sim", 4), F.lit(-1.0)).alias("sim"), "b").agg(F.count(F.lit(1)).alias("n"))


TIERS_SQL = rf"""with {R.LINES_SQL}, c as (select 'order committed sessionid=s<num> soon' as a,
  trim(regexp_replace(regexp_replace(lower(message), '\b\d+\b', ' <num> ', 'g'), '\s+', ' ', 'g')) as b from parsed),
o as (select *, least(length(a), length(b)) / greatest(length(a), length(b)) as r, list_distinct(string_split(a, ' ')) as wa, list_distinct(string_split(b, ' ')) as wb from c),
p as (select *, len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) as v from o)
select case when contains(a, b) or contains(b, a) then 0.95 when r < 0.4 then 0.0 when v > 0.8 then round(0.85 + (v - 0.8) * 0.5, 4) else -1.0 end::double as sim, b, count(*) as n from p group by all"""


def fuzzy_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of texts whose common part stands at the end of one and at the beginning of the other."""
    n = F.col("event_id")
    left = F.concat(F.repeat(F.lit("a"), (n % 9 + 1).cast("int")), "event_type")
    right = F.concat("event_type", F.repeat(F.lit("#"), (n % 4).cast("int")))
    return R.events(spark, d).select("event_id", F.round(T.matching_ratio(F.upper(left), F.upper(right)), 6).alias("ratio"))


#: The common part is all that matches: twice its length over both lengths; an A before it may match none of it.
FUZZY_SQL = "select event_id, round(2.0 * length(event_type) / (2 * length(event_type) + event_id % 9 + 1 + event_id % 4), 6)::double as ratio from events"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Entries that name a file, a function and a line themselves."""
    ev = R.events(spark, d)
    path = F.concat(F.lit("/srv/"), "event_type", F.lit(".py"))
    name = F.when(F.col("event_type") == "error", "process_request").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "view", "other").otherwise("")
    return ev.select(F.col("event_id").cast("string").alias("entry_id"), path.alias("pathname"), name.alias("function"), (F.col("event_id") % 70).cast("int").alias("lineno"), "event_type", F.lit("").alias("module"), F.lit("").alias("logger"))


def totals(ev: DataFrame) -> DataFrame:
    return ev.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("total"))


def structured_evidence(spark: SparkSession, d: str) -> DataFrame:
    return totals(L.structured(asked(spark, d), R.index(spark)["functions"]))


STRUCTURED_SQL = f"""with {R.INDEX_SQL} select f.id as function_id, count(*) as n, cast(sum(70 + case when e.event_id % 70 <> 0 and e.event_id % 70 between start_line and end_line then 20 else 0 end) as bigint) as total
from events e join functions f on f.file = 'svc/' || e.event_type || '.py'
where e.event_type in ('signup', 'click') or (e.event_type = 'error' and name = 'process_request') or (e.event_type = 'purchase' and name = 'commit') group by f.id"""


def with_frames(spark: SparkSession, d: str) -> DataFrame:
    ev = R.events(spark, d)
    name = F.element_at(F.create_map(*[F.lit(x) for f in R.FUNCTIONS for x in (f[4].split("/")[1][:-3], f[1])]), F.col("event_type"))
    frame = lambda file, line, fn: F.struct(file.alias("file"), line.cast("int").alias("line"), fn.alias("function"), F.lit("").alias("source"))
    inner = frame(F.concat(F.lit("/app/"), "event_type", F.lit(".py")), F.col("event_id") % 70, name)
    outer = frame(F.lit("/app/page.py"), F.lit(3), F.lit("show"))
    return ev.select(F.col("event_id").cast("string").alias("entry_id"), F.array(outer, inner).alias("stack_frames"))


def frame_evidence(spark: SparkSession, d: str) -> DataFrame:
    return totals(L.framed(with_frames(spark, d), R.index(spark)["functions"]))


FRAME_SQL = f"""with {R.INDEX_SQL}, x as (select f.id as function_id, 95 + case when e.event_id % 70 between start_line and end_line then 15 else 0 end as s
from events e join functions f on f.file = 'svc/' || e.event_type || '.py' union all select 'py:page:show', 75 from events)
select function_id, count(*) as n, cast(sum(s) as bigint) as total from x group by function_id"""


def name_evidence(spark: SparkSession, d: str) -> DataFrame:
    return totals(L.mentioned(entries(spark, d), R.index(spark)["functions"]))


NAME_SQL = f"""with {R.LINES_SQL}, {R.INDEX_SQL}, w as (select line_no, unnest(list_distinct(regexp_extract_all(lower(line || ' ' || logger), '[a-z]{{3,}}'))) as word from parsed),
x as (select id as function_id, 25 as s from w join functions on word = lower(name) union all select id, 15 from w join functions on word = lower(module))
select function_id, count(*) as n, cast(sum(s) as bigint) as total from x group by function_id"""


def neighbor_boost(spark: SparkSession, d: str) -> DataFrame:
    e, index = with_frames(spark, d), R.index(spark)
    return totals(L.neighbours(e, L.framed(e, index["functions"]), index["functions"], index["call_edges"]))


NEIGHBOUR_SQL = f"""with {R.INDEX_SQL}, fr as (select event_id, event_type as base from events union select event_id, 'page' from events),
cand as (select event_id, f.id, f.name from fr join functions f on f.file = 'svc/' || base || '.py'),
x as (select distinct a.event_id, a.id, 'up' as side from cand a join calls c on c.callee = a.id join cand b on b.event_id = a.event_id and b.id = c.caller
  union all select distinct a.event_id, a.id, 'down' from cand a join calls c on c.caller = a.id join cand b on b.event_id = a.event_id and b.id = c.callee)
select id as function_id, count(*) as n, cast(sum(10) as bigint) as total from x group by id"""


def candidate_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the three most likely source functions of each line."""
    found = L.locate(entries(spark, d), R.index(spark), 3)
    return found.select(F.col("entry_id").cast("bigint").alias("line_no"), F.col("rank").cast("bigint").alias("rank"), "function_id", F.round("score", 3).alias("score"), F.col("line").cast("bigint").alias("line"))


#: Evidence of templates and of names, added up by line and function.
TOTAL_SQL = """hit as (select line_no, case event_type when 'error' then 'log:1' when 'signup' then 'log:2' when 'purchase' then 'log:3' when 'view' then 'log:4' else 'log:5' end as site, level, logger from parsed),
tpl as (select line_no, s.function_id, 85 + case when starts_with(lower(h.level), lower(s.level[1:4])) then 8 else 0 end + case when contains(f.module, h.logger) or contains(f.qualname, h.logger) then 5 else 0 end as s, s.line, 'template match: ' || s.template as reason
  from hit h join sites s on s.id = h.site join functions f on f.id = s.function_id),
w as (select line_no, unnest(list_distinct(regexp_extract_all(lower(line || ' ' || logger), '[a-z]{3,}'))) as word from parsed),
names as (select line_no, id as function_id, 25 as s, null as line, null as reason from w join functions on word = lower(name) union all select line_no, id, 15, null, null from w join functions on word = lower(module)),
total as (select line_no, function_id, sum(s) as score, max(line) as line, max(reason) as reason from (select * from tpl union all select * from names) group by line_no, function_id)"""

TOPK_SQL = f"""with {R.LINES_SQL}, {R.INDEX_SQL}, {TOTAL_SQL},
ranked as (select t.line_no, t.function_id, t.score, coalesce(t.line, f.start_line) as line, row_number() over (partition by t.line_no order by t.score desc, f.file, coalesce(t.line, f.start_line), t.function_id) as rank from total t join functions f on f.id = t.function_id)
select line_no, rank, function_id, round(cast(score as double), 3) as score, cast(line as bigint) as line from ranked where rank <= 3"""


def edge_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions, calls by part name or brand: only names with one meaning resolve."""
    part = spark.read.parquet(f"{d}/part.parquet")
    fns = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualname"), F.col("p_type").alias("module"))
    calls = part.select(F.col("p_partkey").cast("string").alias("caller"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(".", "p_brand", "p_name")).alias("callee"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(0.5).alias("confidence"))
    out = ix.resolve_edges(calls, fns)
    return out.select("caller", "callee", "confidence")


EDGE_SQL = """with f as (select cast(p_partkey as varchar) as id, p_name as name, p_brand || '.' || p_name as qualname, p_type || '.' || p_brand || '.' || p_name as fq from part),
k as (select key, count(*) as c, min(id) as id from (select name as key, id from f union all select qualname, id from f union all select fq, id from f) group by key),
c as (select cast(p_partkey as varchar) as caller, case when p_partkey % 2 = 0 then p_name else p_brand || '.' || p_name end as raw from part),
t as (select *, string_split(raw, '.')[-1] as tail from c)
select caller, case when a.key is not null then (case when a.c = 1 then a.id else raw end) when b.c = 1 then b.id else raw end as callee,
  case when (a.key is not null and a.c = 1) or (a.key is null and b.c = 1) then 0.9 else 0.5 end::double as confidence
from t left join k a on a.key = raw left join k b on b.key = tail"""


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as functions that call their nation's smallest supplier."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m"))
    edges = s.join(first, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("caller"), F.when(F.col("s_suppkey") % 5 == 0, "outside").otherwise(F.col("m").cast("string")).alias("callee"))
    callers, callees = L.adjacency(s.select(F.col("s_suppkey").cast("string").alias("id")), edges)
    both = callers.join(callees, "id", "full")
    return both.select("id", F.array_join(F.coalesce("callers", F.array().cast("array<string>")), ",").alias("callers"), F.array_join(F.coalesce("callees", F.array().cast("array<string>")), ",").alias("callees"))


ADJACENCY_SQL = """with e as (select cast(s_suppkey as varchar) as caller, case when s_suppkey % 5 = 0 then 'outside' else cast(min(s_suppkey) over (partition by s_nationkey) as varchar) end as callee from supplier),
a as (select callee as id, string_agg(distinct caller, ',' order by caller) as callers from e where callee <> 'outside' group by callee), b as (select caller as id, string_agg(distinct callee, ',' order by callee) as callees from e group by caller)
select id, coalesce(callers, '') as callers, coalesce(callees, '') as callees from a full join b using (id)"""


def subgraph_focus(spark: SparkSession, d: str) -> DataFrame:
    """Region 1's nations as candidates that call the next nation: nodes and edges of the focus."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    fns = n.select(F.col("n_nationkey").cast("string").alias("id"))
    edges = n.select(F.col("n_nationkey").cast("string").alias("caller"), ((F.col("n_nationkey") + 1) % 25).cast("string").alias("callee"))
    nodes, kept = ix.focus(n.filter("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("function_id")), fns, edges)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionAll(kept.select(F.lit("edge"), "caller", "callee"))


FOCUS_SQL = """with e as (select n_nationkey as a, (n_nationkey + 1) % 25 as b from nation), c as (select n_nationkey as id from nation where n_regionkey = 1),
f as (select id from c union select a from e join c on b = id union select b from e join c on a = id)
select 'node' as kind, cast(id as varchar) as a, '' as b from f union all select 'edge', cast(a as varchar), cast(b as varchar) from e where a in (from f) and b in (from f)"""


def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files: which are new or changed since a scan that lacks some and saw other prices."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    now = o.select(F.col("o_orderkey").cast("string").alias("file"), F.col("o_custkey").cast("string").alias("signature"))
    before = o.filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").cast("string").alias("file"), F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise(F.col("o_custkey").cast("string")).alias("signature"))
    before = before.unionAll(spark.createDataFrame([("gone", "x")], "file string, signature string"))
    changed, stale = ix.changes(now, before)
    return changed.select(F.lit("parse").alias("kind"), "file").unionAll(stale.select(F.lit("stale"), "file"))


INCREMENTAL_SQL = """select 'parse' as kind, cast(o_orderkey as varchar) as file from orders where o_orderkey % 10 = 3 or o_orderkey % 7 = 0
union all select 'stale', cast(o_orderkey as varchar) from orders where o_orderkey % 10 <> 3 and o_orderkey % 7 = 0 union all select 'stale', 'gone'"""


def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of locating every rendered line against places that are up to six lines off the site that it was rendered
    from, and some in another function."""
    site = {"error": 0, "signup": 1, "purchase": 2, "view": 3, "click": 4}
    want = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, s in site.items() for x in (k, i(s))]), F.col("event_type"))
    fn = {f[0]: f for f in R.FUNCTIONS}
    e = R.events(spark, d)
    corpus = e.select((F.col("event_id") + 1).cast("string").alias("id"), F.struct(want(lambda s: R.SITES[s][4].split("/")[1]).alias("file"), F.when(F.col("event_id") % 11 == 5, F.lit("nobody")).otherwise(want(lambda s: fn[R.SITES[s][1]][1])).alias("function"), (want(lambda s: R.SITES[s][5]) + F.col("event_id") % 7).cast("int").alias("line")).alias("expected"))
    out = L.evaluate(corpus, entries(spark, d), R.index(spark))
    return out.agg(F.count(F.lit(1)).alias("total"), F.count_if("top1").alias("top1"), F.count_if("hit").alias("top3"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))


EVAL_SQL = """with h as (select event_id % 7 <= 3 and event_id % 11 <> 5 as hit from events)
select count(*) as total, count(*) filter (hit) as top1, count(*) filter (hit) as top3, round(avg(case when hit then 1.0 else 0.0 end), 6)::double as accuracy from h"""

QUERIES = {
    "template_match_join": (template_match_join, MATCH_SQL),
    "template_keyword_prefilter": (template_keyword_prefilter, PREFILTER_SQL),
    "canonical_similarity_tiers": (canonical_similarity_tiers, TIERS_SQL),
    "fuzzy_similarity": (fuzzy_similarity, FUZZY_SQL),
    "structured_evidence": (structured_evidence, STRUCTURED_SQL),
    "frame_evidence": (frame_evidence, FRAME_SQL),
    "name_evidence": (name_evidence, NAME_SQL),
    "neighbor_boost": (neighbor_boost, NEIGHBOUR_SQL),
    "candidate_topk": (candidate_topk, TOPK_SQL),
    "edge_resolution": (edge_resolution, EDGE_SQL),
    "adjacency": (adjacency, ADJACENCY_SQL),
    "subgraph_focus": (subgraph_focus, FOCUS_SQL),
    "incremental_antijoin": (incremental_antijoin, INCREMENTAL_SQL),
    "eval_accuracy": (eval_accuracy, EVAL_SQL),
}
