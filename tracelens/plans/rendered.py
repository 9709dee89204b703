"""Log lines rendered from the ``events`` table, the same on both sides of an oracle check, and literal code indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Message template and level of each event type.
MESSAGES = {
    "error": ("ERROR", "Failed to process request, timeout"),
    "signup": ("WARN", "retry attempt"),
    "purchase": ("INFO", "Order committed"),
    "view": ("INFO", "page state=Loaded"),
    "click": ("INFO", "clicked item"),
}
#: Literal index: functions (id, name, qualname, module, file, first and last line), log sites and calls.
FUNCTIONS = [
    ("py:svc.error:process_request", "process_request", "process_request", "svc.error", "svc/error.py", 10, 30, "function"),
    ("py:svc.signup:retry_signup", "retry_signup", "retry_signup", "svc.signup", "svc/signup.py", 5, 22, "function"),
    ("py:svc.purchase:Orders.commit", "commit", "Orders.commit", "svc.purchase", "svc/purchase.py", 40, 61, "method"),
    ("py:svc.view:render", "render", "render", "svc.view", "svc/view.py", 3, 9, "function"),
    ("py:svc.click:item", "item", "item", "svc.click", "svc/click.py", 1, 8, "function"),
    ("py:page:show", "show", "show", "page", "svc/page.py", 1, 20, "function"),
]
SITES = [
    ("log:1", "py:svc.error:process_request", "error", "Failed to process %s, timeout", "svc/error.py", 17, ""),
    ("log:2", "py:svc.signup:retry_signup", "warning", "retry attempt", "svc/signup.py", 11, ""),
    ("log:3", "py:svc.purchase:Orders.commit", "info", "Order committed sessionId=%s", "svc/purchase.py", 52, ""),
    ("log:4", "py:svc.view:render", "info", "page state={}", "svc/view.py", 6, ""),
    ("log:5", "py:svc.click:item", "info", "clicked item", "svc/click.py", 4, ""),
    ("log:6", "py:page:show", "debug", "page shown to {} after {} ms", "svc/page.py", 12, ""),
]
CALLS = [("py:page:show", "py:svc.view:render"), ("py:svc.view:render", "py:svc.click:item"), ("py:svc.purchase:Orders.commit", "py:svc.error:process_request"), ("py:svc.signup:retry_signup", "send_mail")]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def chosen(column, index: int):
    out = F
    for name, row in MESSAGES.items():
        out = out.when(column == name, F.lit(row[index]))
    return out


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line, ts): one standard-format line per event."""
    kind = F.col("event_type")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), chosen(kind, 0), F.lit(" svc."), kind, F.lit(" - "), chosen(kind, 1), F.lit(" sessionId=s"),
        F.col("user_id").cast("string"), F.lit(" duration="), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("ms"),
    )
    return events(spark, sf_dir).select(F.lit("app.log").alias("file"), (F.col("event_id") + 1).alias("line_no"), line.alias("line"), "ts")


def case(index: int) -> str:
    return "case event_type " + " ".join(f"when '{k}' then '{v[index]}'" for k, v in MESSAGES.items()) + " end"


#: The same lines in SQL.
LINES_SQL = f"""rendered as (select event_id + 1 as line_no, ts, event_type, user_id, value,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as tstext, {case(0)} as level, {case(1)} as template,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {case(0)} || ' svc.' || event_type || ' - ' || {case(1)} || ' sessionId=s' || user_id
    || ' duration=' || cast(round(value * 100) as bigint) || 'ms' as line from events),
parsed as (select *, 'svc.' || event_type as logger, template || ' sessionId=s' || user_id || ' duration=' || cast(round(value * 100) as bigint) || 'ms' as message,
  's' || user_id as session_id, cast(round(value * 100) as bigint) as ms, case event_type when 'view' then 'Loaded' else '' end as state,
  case event_type when 'error' then 'timeout' when 'signup' then 'retry' when 'view' then 'state' else 'duration' end as type from rendered)"""


def index(spark: SparkSession) -> dict[str, DataFrame]:
    from ..functions.text import template_regex

    return {
        "functions": spark.createDataFrame(FUNCTIONS, "id string, name string, qualname string, module string, file string, start_line int, end_line int, kind string"),
        "call_edges": spark.createDataFrame([(a, b, "", 0, 0.9) for a, b in CALLS], "caller string, callee string, file string, line int, confidence double"),
        "log_sites": spark.createDataFrame([(i, f, lv, t, template_regex(t), p, n, g) for i, f, lv, t, p, n, g in SITES], "id string, function_id string, level string, template string, regex string, file string, line int, logger string"),
    }


def values(rows, names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + f") as t({names})"


INDEX_SQL = f"""functions as (select * from {values(FUNCTIONS, 'id, name, qualname, module, file, start_line, end_line, kind')}),
sites as (select * from {values(SITES, 'id, function_id, level, template, file, line, logger')}),
calls as (select * from {values(CALLS, 'caller, callee')})"""
