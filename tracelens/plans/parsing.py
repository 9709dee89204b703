"""Queries of log scans and the parse cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import carried, numbered_by
from ..functions.text import normalize, text_or_empty
from ..operators import parse
from ..sources.files import log_lines_of
from . import rendered as R


def log_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.lines(spark, d).select("line_no", "line")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse.entries(R.lines(spark, d).withColumnRenamed("line", "raw"))


def plain_parse_standard(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("line_no", "level", "timestamp", "logger", "message")


#: One line of each format, by event id modulo ten: Spark and SQL text around the fields.
SHAPES = [
    ("2024-01-15 10:30:45.123 100-200 Tag com.app I msg ", "logcat_table", "INFO", "Tag"),
    ("01-15 10:30:45.123 100 200 W Tag: msg ", "logcat", "WARN", "Tag"),
    ("E/Tag( 12): msg ", "logcat_legacy", "ERROR", "Tag"),
    ("2024-01-15 10:30:45,123 INFO [main] a.b.C - msg ", "log4j", "INFO", "a.b.C"),
    ("2024-01-15 10:30:45.123 [main] WARN a.b.C - msg ", "logback", "WARN", "a.b.C"),
    ("2024-01-15 10:30:45 ERROR a.b - msg ", "standard", "ERROR", "a.b"),
    ("INFO [a.b] msg ", "bracket", "INFO", "a.b"),
    ("WARN: msg ", "simple", "WARN", ""),
    ("Jan 15 10:30:45 host prog[12]: msg ", "syslog", "INFO", "prog"),
    ("timestamp=2024 level=error message=msg ", "key_value", "ERROR", ""),
]


def plain_format_cascade(spark: SparkSession, d: str) -> DataFrame:
    ev = R.events(spark, d)
    shape = F.element_at(F.array(*[F.lit(s[0]) for s in SHAPES]), (F.col("event_id") % 10 + 1).cast("int"))
    rows = ev.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), F.concat(shape, F.col("event_type")).alias("raw"))
    return parse.entries(rows).groupBy("fmt", "level", "logger", "message").agg(F.count(F.lit(1)).alias("n"))


CASCADE_SQL = (
    "select fmt, level, logger, 'msg ' || event_type as message, count(*) as n from events join (values "
    + ", ".join(f"({i}, '{s[1]}', '{s[2]}', '{s[3]}')" for i, s in enumerate(SHAPES))
    + ") as s(k, fmt, level, logger) on event_id % 10 = k group by all"
)


def json_line_parse(spark: SparkSession, d: str) -> DataFrame:
    ev = R.events(spark, d)
    line = F.to_json(F.struct(F.col("event_type").alias("msg"), F.when(F.col("event_id") % 2 == 0, "").otherwise("warn").alias("level"), F.lit("info").alias("levelname"), F.col("event_id").alias("line"), F.col("user_id").cast("string").alias("funcName")))
    e = parse.entries(ev.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), line.alias("raw")))
    return e.select("line_no", "message", "level", F.col("lineno").cast("bigint").alias("lineno"), F.col("function").alias("func"))


JSON_SQL = "select event_id as line_no, event_type as message, case when event_id % 2 = 0 then 'INFO' else 'WARN' end as level, case when event_id = 0 then null else event_id end as lineno, cast(user_id as varchar) as func from events"


def block_split(spark: SparkSession, d: str) -> DataFrame:
    """Blocks over event lines among which every seventh is an exception and every third a continuation."""
    n = F.col("line_no")
    line = F.when(n % 7 == 0, F.lit("java.io.IOException: broken")).when(n % 3 == 0, F.concat(F.lit("  continued "), n.cast("string"))).otherwise(F.col("line"))
    out = parse.blocks(R.lines(spark, d).withColumn("line", line))
    return out.select("line_no", F.size(F.split("raw", "\n")).cast("bigint").alias("n_lines"))


BLOCK_SQL = f"""with {R.LINES_SQL}, marked as (select line_no, case when line_no % 7 = 0 then 1 else 0 end as e,
  case when line_no % 7 <> 0 and line_no % 3 <> 0 then 1 else 0 end as s from rendered),
inside as (select *, coalesce(sum(e) over (order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 as i from marked),
numbered as (select *, sum(case when s = 1 and e = 0 and i = 0 then 1 else 0 end) over (order by line_no) as b from inside)
select min(line_no) as line_no, count(*) as n_lines from numbered group by b"""


def logical_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line heads a logcat table row; its package and an identifier decide."""
    n = F.col("line_no")
    head = F.concat(F.lit("2024-01-15 10:30:45.123 1-2 Tag com.app"), (n % 3).cast("string"), F.lit(" I "), F.lit("head"))
    lines = R.lines(spark, d).withColumn("line", F.when(n % 5 == 0, head).otherwise(F.col("line")))
    out = parse.logical_entries(lines, ["com.app1", "svc.view"], app_only=True)
    return out.select("line_no", F.size(F.split("raw", "\n")).cast("bigint").alias("n_lines"))


LOGICAL_SQL = f"""with {R.LINES_SQL}, g as (select line_no, line, sum(case when line_no % 5 = 0 then 1 else 0 end) over (order by line_no) as g from rendered),
e as (select min(line_no) as line_no, count(*) as n_lines, arg_min(line, line_no) as first from g group by case when g = 0 then -line_no else g end)
select line_no, n_lines from e where (line_no % 5 = 0 and line_no % 3 = 1) or (line_no % 5 <> 0 and contains(first, 'svc.view'))"""


def traceback_frames(spark: SparkSession, d: str) -> DataFrame:
    ev = R.events(spark, d)
    raw = F.concat(
        F.lit('Traceback (most recent call last):\n  File "/app/svc/'), "event_type", F.lit('.py", line '), F.col("user_id").cast("string"), F.lit(", in run\n    go()\n  File \"/app/lib.py\", line 7, in go\n    raise\n"),
        F.lit("ValueError: bad "), "event_type",
    )
    e = parse.entries(ev.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), raw.alias("raw")))
    frame = F.col("stack_frames")[0]
    return e.select("line_no", "exception_type", "message", frame["file"].alias("frame_file"), frame["line"].cast("bigint").alias("frame_line"), frame["function"].alias("frame_function"), frame["source"].alias("frame_source"), F.size("stack_frames").cast("bigint").alias("frames"))


TRACEBACK_SQL = "select event_id as line_no, 'ValueError' as exception_type, 'Traceback (most recent call last):' as message, '/app/svc/' || event_type || '.py' as frame_file, user_id as frame_line, 'run' as frame_function, 'go()' as frame_source, 2 as frames from events"
TRACEBACK_SQL = TRACEBACK_SQL.replace("'Traceback (most recent call last):' as message", "'bad ' || event_type as message").replace("2 as frames", "cast(2 as bigint) as frames")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(normalize("text").cast("binary")).alias("digest"))


#: White space as Unicode has it.
NORMALIZE_SQL = r"select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) as digest from documents"


def carry_forward_scope(spark: SparkSession, d: str) -> DataFrame:
    """The last line before each that begins a sentence with The, and a running count of commas, over the lines of documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", text_or_empty("text"))
    lines = log_lines_of(docs, "doc_id", "text").withColumn("commas", F.length("line") - F.length(F.replace("line", F.lit(","), F.lit(""))))
    lines = lines.withColumn("begins", F.when(F.col("line").startswith("The "), F.col("line_no"))).drop("line")
    marked = numbered_by(carried(lines, "scope", "begins"), "depth", "commas")
    return marked.groupBy(F.col("file").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("scope").cast("bigint").alias("scopes"), F.sum("depth").cast("bigint").alias("depths"))


CARRY_SQL = r"""with l as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\n|\r')) as line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\n|\r'), 1) as line_no from documents),
m as (select doc_id, last_value(case when starts_with(line, 'The ') then line_no end ignore nulls) over w as scope, sum(length(line) - length(replace(line, ',', ''))) over w as depth
  from l window w as (partition by doc_id order by line_no rows between unbounded preceding and current row))
select doc_id, count(*) as n, cast(sum(scope) as bigint) as scopes, cast(sum(depth) as bigint) as depths from m group by doc_id"""

QUERIES = {
    "log_lines_scan": (log_lines_scan, f"with {R.LINES_SQL} select line_no, line from rendered"),
    "plain_parse_standard": (plain_parse_standard, f"with {R.LINES_SQL} select line_no, level, tstext as timestamp, logger, message from parsed".replace("tstext as timestamp", "tstext as \"timestamp\"")),
    "plain_format_cascade": (plain_format_cascade, CASCADE_SQL),
    "json_line_parse": (json_line_parse, JSON_SQL),
    "block_split": (block_split, BLOCK_SQL),
    "logical_entries": (logical_entries, LOGICAL_SQL),
    "traceback_frames": (traceback_frames, TRACEBACK_SQL),
    "normalize_text_q": (normalize_text, NORMALIZE_SQL),
    "carry_forward_scope": (carry_forward_scope, CARRY_SQL),
}
