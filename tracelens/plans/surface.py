"""Queries of readers, extractors, profiles and reports, each against SQL over the table it is made from."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import index as ix
from ..operators import locate as L
from ..operators import quality as Q
from ..operators import rules
from ..sources import extract, files
from . import rendered as R
from .analysis import events
from .evidence import TOTAL_SQL, entries
from .parsing import parsed
from .reports import PROBLEMS_SQL, PROFILE


def scratch(spark: SparkSession) -> str:
    """A new folder, in the one that driver and executors share where there is one."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared:
        Path(shared).mkdir(parents=True, exist_ok=True)
    return tempfile.mkdtemp(prefix="tracelens-", dir=shared or None)


def log_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rendered log written as one text file and read back, numbered."""
    path = f"{scratch(spark)}/log"
    R.lines(spark, d).orderBy("line_no").select("line").coalesce(1).write.text(path)
    return files.log_lines(spark, path).select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def tree(spark: SparkSession) -> str:
    root = Path(scratch(spark))
    for name in ("app/a.py", "app/b/c.kt", "build/x.py", "generated/y.py", "target/z.go", "app/readme.md", "lib/q.java", "lib/test_q.java", "w.cpp", ".git/h.py", "app/d.tsx"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("def f():\n    pass\n" if name.endswith("py") else "x\n")
    return str(root)


def source_tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a small tree, without skipped folders and an excluded pattern."""
    return files.source_files(spark, tree(spark), ["test_*"]).select("file", "module", "language", F.col("length").cast("bigint").alias("length"))


TREE_SQL = """select * from (values ('app/a.py', 'app.a', 'python', 18::bigint), ('app/b/c.kt', 'app.b.c', 'kotlin', 2), ('target/z.go', 'target.z', 'go', 2), ('lib/q.java', 'lib.q', 'java', 2),
('w.cpp', 'w', 'c', 2), ('app/d.tsx', 'app.d', 'typescript', 2)) as t(file, module, language, length)"""

#: Sources in each language, with N for a number: code, then what is in it (kind, name, line, template, level).
SOURCES = {
    "java": (
        'public class OrderN {\n  public void save(int x) {\n    log.info("saved order N");\n  }\n  private int load() {\n    logger.error("cannot load N");\n  }\n}\n',
        [("function", "OrderN.save", 2, "", ""), ("function", "OrderN.load", 5, "", ""), ("site", "OrderN.save", 3, "saved order N", "info"), ("site", "OrderN.load", 6, "cannot load N", "error")],
    ),
    "typescript": (
        "export class CartN {\n  async add(x: number) {\n    console.warn(`added ${x} to N`);\n  }\n}\nexport const totalN = (a) => {\n  console.log('total of N');\n};\n",
        [("function", "CartN.add", 2, "", ""), ("function", "totalN", 6, "", ""), ("site", "CartN.add", 3, "added {} to N", "warn"), ("site", "totalN", 7, "total of N", "info")],
    ),
    "go": (
        'package main\n\nfunc StartN() {\n\tlog.Printf("starting N")\n}\n\nfunc (s *Server) StopN() {\n\tlogger.Errorf("stopping N failed")\n\tfmt.Println("bye N")\n}\n',
        [("function", "StartN", 3, "", ""), ("function", "StopN", 7, "", ""), ("site", "StartN", 4, "starting N", "info"), ("site", "StopN", 8, "stopping N failed", "error"), ("site", "StopN", 9, "bye N", "info")],
    ),
    "c": (
        '#include <stdio.h>\nstatic int open_fileN(const char *p)\n{\n  /* } */\n  if (!p) {\n    perror("open file N");\n  }\n  printf("opened %s of N", p);\n  return 0;\n}\nvoid Store::close() {\n  syslog(LOG_ERR, "close failed N");\n}\n',
        [("function", "open_fileN", 2, "", ""), ("function", "Store::close", 11, "", ""), ("site", "open_fileN", 6, "open file N", "error"), ("site", "open_fileN", 8, "opened %s of N", "info"), ("site", "Store::close", 12, "close failed N", "err")],
    ),
    "kotlin": (
        'class BoxN {\n  fun put(x: Int) {\n    Log.d("box", "put $x into N")\n    push(x)\n  }\n}\nfun pushN(x: Int) {\n  Log.e("top", "pushed N")\n}\n',
        [
            ("function", "BoxN.put", 2, "", ""), ("function", "pushN", 7, "", ""), ("call", "Log.d", 3, "", ""), ("call", "push", 4, "", ""), ("call", "Log.e", 8, "", ""),
            ("site", "BoxN.put", 3, "put {} into N", "d"), ("site", "pushN", 8, "pushed N", "e"),
        ],
    ),
}


def extract_languages(spark: SparkSession, d: str) -> DataFrame:
    """Functions, calls and log sites of generated sources in five languages, one file of each per supplier."""
    n = F.col("s_suppkey").cast("string")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    each = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(code).alias("code")) for k, (code, _) in SOURCES.items()])
    rows = s.select(n.alias("n"), F.explode(each).alias("x"))
    made = rows.select(F.concat("x.language", F.lit("/f"), "n", F.lit(".src")).alias("file"), F.concat(F.lit("f"), "n").alias("module"), "x.language", F.encode(F.replace("x.code", F.lit("N"), F.col("n")), "utf-8").alias("content"))
    # N is also a letter of NULL and the like; the codes hold no other
    return extract.extract(made).select("kind", "file", "name", F.col("line").cast("bigint").alias("line"), "template", "level")


LANGUAGES_SQL = "with s as (select cast(s_suppkey as varchar) as n from supplier) " + " union all ".join(
    f"select '{kind}' as kind, '{language}/f' || n || '.src' as file, replace('{name}', 'N', n) as name, {line}::bigint as line, replace('{template}', 'N', n) as template, '{level}' as level from s"
    for language, (_, rows) in SOURCES.items()
    for kind, name, line, template, level in rows
)

MANUAL = {
    "session_keys": ["duration"], "states": ["committed"],
    "learned_patterns": [
        {"pattern": "order committed", "type": "project:commit", "source": "manual_profile"}, {"pattern": "page state", "type": "project:page_shown", "source": "manual_profile"}, {"pattern": "item", "type": "project:clicked"},
    ],
    "events": {"bought": {"type": "commit", "patterns": ["order committed"]}},
}


def profile_events(spark: SparkSession, d: str) -> DataFrame:
    """Events under a profile: its manual patterns go before the fixed rules, learned ones after; its keys and states first."""
    return E.events(parsed(spark, d), MANUAL).select("line", "type", "label", "session_key", "session_id", "state")


PROFILE_SQL = f"""with {R.LINES_SQL} select line_no as line,
case event_type when 'purchase' then 'project:commit' when 'view' then 'project:page_shown' else type end as type,
case event_type when 'purchase' then 'bought' when 'view' then 'page_shown' else type end as label, 'duration' as session_key, ms || 'ms' as session_id,
case event_type when 'purchase' then 'committed' else state end as state from parsed"""


def top_sources(spark: SparkSession, d: str) -> DataFrame:
    """The five best functions with the first line that names each."""
    e = entries(spark, d)
    found = L.locate(e, R.index(spark), 3).join(e.select("entry_id", "raw", "line_no"), "entry_id")
    return rules.top_sources(found).select("function_id", F.col("score").cast("bigint").alias("score"), F.md5(F.col("first_log").cast("binary")).alias("first_log"))


SOURCES_SQL = f"""with {R.LINES_SQL}, {R.INDEX_SQL}, {TOTAL_SQL},
ranked as (select t.line_no, t.function_id, t.score, row_number() over (partition by t.line_no order by t.score desc, f.file, coalesce(t.line, f.start_line), t.function_id) as rank from total t join functions f on f.id = t.function_id qualify rank <= 3),
best as (select function_id, max(score) as score, min(line_no) filter (rank <= 3) as first_line from ranked group by function_id),
spot as (select function_id, arg_min(line_no, (-score, line_no, rank)) as line_no from ranked group by function_id)
select function_id, cast(score as bigint) as score, md5(line) as first_log from best join spot using (function_id) join parsed p on p.line_no = best.first_line order by score desc, spot.line_no, function_id limit 5"""


def context_set(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the first ten timeouts, then of the first ten retries."""
    of = lambda kind: events(spark, d).filter(F.col("type") == kind).select("file", F.col("line").alias("line_no"))
    return rules.context_set(R.lines(spark, d), of("timeout"), of("retry"), 1).select("ord", F.col("line_no").cast("bigint").alias("line_no"), F.md5(F.col("context").cast("binary")).alias("context"))


CONTEXT_SET_SQL = f"""with {R.LINES_SQL}, w as (select line_no, type, string_agg(line, chr(10)) over (order by line_no rows between 1 preceding and 1 following) as c from parsed),
c as ((select 0 as ord, line_no, c from w where type = 'timeout' order by line_no limit 10) union all (select 1, line_no, c from w where type = 'retry' order by line_no limit 10)) select ord, line_no, md5(c) as context from c"""


def query_focus(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    return rules.query_focus(e, ["purchase", "retry", "nothing", "state"])


FOCUS_SQL = f"with {R.LINES_SQL}, t as (select unnest(['purchase', 'retry', 'nothing', 'state']) as term) select term, count(*) as n from t join parsed on contains(lower(line), term) group by term"


def lint_query_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a lint under a query counts; a query that no line holds leaves all of them."""
    lines = R.lines(spark, d)
    parts = [Q.lines_for(lines, q).agg(F.lit(q).alias("query"), F.count(F.lit(1)).alias("n")) for q in ("", "Purchase or timeout", "no-such-word")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


LINT_QUERY_SQL = f"""with {R.LINES_SQL} select '' as query, count(*) as n from rendered union all select 'no-such-word', count(*) from rendered
union all select 'Purchase or timeout', count(*) from rendered where contains(lower(line), 'purchase') or contains(lower(line), 'or') or contains(lower(line), 'timeout')"""


def cleanup_items(spark: SparkSession, d: str) -> DataFrame:
    """What a lint proposes to remove or to review."""
    patch = Q.cleanup_patch(Q.lint(spark, PROFILE, R.lines(spark, d)))
    return spark.createDataFrame([(k, x) for k, v in patch.items() for x in v], "target string, item string")


CLEANUP_SQL = f"""with problems as ({PROBLEMS_SQL}), t as (select * from (values ('suspicious_session_key', 'remove_session_keys'), ('empty_event', 'remove_events'), ('invalid_event', 'remove_events'),
('unused_session_key', 'review_session_keys'), ('unmatched_event', 'review_events'), ('undefined_sequence_event', 'review_sequences')) as m(type, target)) select distinct target, subject as item from problems join t using (type)"""


def index_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes of suppliers as functions merged: the newer row of an id counts, calls resolve over all functions."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("k", F.col("s_suppkey").cast("string"))

    def part(df: DataFrame, line: int) -> dict[str, DataFrame]:
        fns = df.select("k", F.concat(F.lit("f"), "k").alias("name")).select(F.col("k").alias("id"), "name", F.concat_ws(".", F.lit("C"), "name").alias("qualname"), F.lit("m").alias("module"), F.lit("m.py").alias("file"), F.lit(line).alias("start_line"))
        calls = df.select(F.col("k").alias("caller"), F.concat(F.lit("f"), (F.col("s_suppkey") + 1).cast("string")).alias("callee"), F.lit("m.py").alias("file"), F.lit(1).alias("line"), F.lit(0.5).alias("confidence"))
        return {"functions": fns, "call_edges": calls.withColumn("raw", F.col("callee"))}

    out = ix.merged(part(s.filter("s_suppkey % 3 <> 0"), 1), part(s.filter("s_suppkey % 3 = 0 or s_suppkey % 2 = 0"), 2))
    return out["functions"].select(F.lit("function").alias("kind"), F.col("id").alias("a"), F.col("start_line").cast("string").alias("b")).unionAll(out["call_edges"].select(F.lit("call"), "caller", "callee").distinct())


MERGE_SQL = """with s as (select s_suppkey as k from supplier) select 'function' as kind, cast(k as varchar) as a, case when k % 3 = 0 or k % 2 = 0 then '2' else '1' end as b from s
union all select 'call', cast(k as varchar), case when k + 1 in (select k from s) then cast(k + 1 as varchar) else 'f' || (k + 1) end from s"""


def json_index_import(spark: SparkSession, d: str) -> DataFrame:
    """The literal index written as one JSON document and read as tables."""
    path = Path(scratch(spark)) / "index.json"
    functions = {f[0]: dict(zip(("name", "qualname", "module", "file", "start_line", "end_line", "kind"), f[1:])) for f in R.FUNCTIONS}
    sites = {s[0]: dict(zip(("function_id", "level", "template", "file", "line", "logger"), s[1:])) | {"regex": ""} for s in R.SITES}
    calls = [{"caller": a, "callee": b, "file": "", "line": 0, "confidence": 0.9} for a, b in R.CALLS]
    path.write_text(json.dumps({"functions": functions, "log_sites": sites, "calls": calls, "metadata": {"file_signatures": {"a.py": "1:2"}}}))
    t = files.load_index(spark, str(path))
    return (
        t["functions"].select(F.lit("function").alias("kind"), "id", F.concat_ws(":", "file", "start_line", "end_line").alias("detail")).unionAll(t["log_sites"].select(F.lit("site"), "id", F.concat_ws(":", "function_id", "template")))
        .unionAll(t["call_edges"].select(F.lit("call"), "caller", "callee")).unionAll(t["file_signatures"].select(F.lit("file"), "file", "signature"))
    )


IMPORT_SQL = f"""with {R.INDEX_SQL} select 'function' as kind, id, file || ':' || start_line || ':' || end_line as detail from functions union all select 'site', id, function_id || ':' || template from sites
union all select 'call', caller, callee from calls union all select 'file', 'a.py', '1:2'"""

QUERIES = {
    "log_file_lines": (log_file_lines, f"with {R.LINES_SQL} select line_no, line from rendered"),
    "source_tree_scan": (source_tree_scan, TREE_SQL),
    "extract_languages": (extract_languages, LANGUAGES_SQL),
    "profile_events": (profile_events, PROFILE_SQL),
    "top_sources": (top_sources, SOURCES_SQL),
    "context_set": (context_set, CONTEXT_SET_SQL),
    "query_focus": (query_focus, FOCUS_SQL),
    "lint_query_filter": (lint_query_filter, LINT_QUERY_SQL),
    "cleanup_items": (cleanup_items, CLEANUP_SQL),
    "index_merge": (index_merge, MERGE_SQL),
    "json_index_import": (json_index_import, IMPORT_SQL),
}
