"""Log text to structured entries: blocks, logical entries, and the parse cascade; all of it native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.frames import numbered_by
from ..functions.text import settled, text_or_empty


def joined(rows: Column) -> Column:
    """Lines of collected (line_no, line) pairs in order, joined by line feeds."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), "\n")


def blocks(lines: DataFrame) -> DataFrame:
    """(file, line_no, raw): entries of one or more lines. An exception line opens a stretch that keeps all lines up to the
    next exception line; outside of it, a line that looks like an entry's beginning starts a new block."""
    marked = lines.select("file", "line_no", "line", F.col("line").rlike(P.EXCEPTION_LINE).cast("int").alias("e"), F.col("line").rlike(P.ENTRY_START).alias("s"))
    counted = numbered_by(marked, "so_far", "e")
    starts = (F.col("s") & (F.col("e") == 0) & (F.col("so_far") % 2 == 0)).cast("int")
    numbered = numbered_by(counted.withColumn("starts", starts), "block", "starts")
    out = numbered.groupBy("file", "block").agg(F.min("line_no").alias("line_no"), joined(F.collect_list(F.struct("line_no", "line"))).alias("raw"))
    return out.filter(F.trim("raw") != "").select("file", "line_no", "raw")


def logical_entries(lines: DataFrame, identifiers: list[str] | None = None, app_only: bool = False) -> DataFrame:
    """(file, line_no, raw): under a logcat table's header lines are one entry each header; before the first, each line is one.
    ``app_only`` keeps entries of the named packages, or that mention an identifier."""
    marked = lines.withColumn("head", F.col("line").rlike(P.TABLE_HEADER)).withColumn("heads", F.col("head").cast("int"))
    marked = numbered_by(marked, "grp", "heads")
    unit = F.when(F.col("grp") == 0, F.concat(F.lit("l"), F.col("line_no").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("grp").cast("string")))
    out = marked.groupBy("file", unit.alias("u")).agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("first"), F.max("head").alias("head"), joined(F.collect_list(F.struct("line_no", "line"))).alias("raw"))
    if app_only and identifiers:
        mentioned = F.exists(F.array(*map(F.lit, identifiers)), lambda x: F.contains(F.col("first"), x))
        out = out.filter(mentioned | (F.col("head") & F.regexp_extract("first", P.TABLE_HEADER, 1).isin(identifiers)))
    return out.filter(F.trim("raw") != "").select("file", "line_no", "raw")


def truthy(fields: Column, *names: str) -> Column:
    """The first of some JSON fields that is neither missing, empty, zero nor false."""
    values = [F.try_element_at(fields, F.lit(n)) for n in names]
    falsy = ["", "false", "[]", "{}"] + (["0"] if "line" in names else [])
    return F.coalesce(*[F.when(~v.isin(falsy), v) for v in values])


#: Stands between the captured fields of a line; a private-use character, which logs don't hold.
BETWEEN = "\ue0f1"


def plain_match(line: Column) -> Column:
    """Name of the first format that a line has, and its captured fields, as one array; the name is empty if it has none."""
    out = F
    for name, pattern, groups in P.FORMATS:
        captured = F.regexp_replace(line, pattern + "(?s:.*)", BETWEEN.join([name, *(f"${i + 1}" for i in range(len(groups)))]))
        out = out.when(line.rlike(pattern), F.split(captured, BETWEEN, -1))
    return out.otherwise(F.array(F.lit("")))


def plain_field(match: Column, field: str) -> Column:
    """A captured field of a match; empty if its format has none."""
    out = None
    for name, _, groups in P.FORMATS:
        if field in groups:
            out = (F if out is None else out).when(match[0] == name, match[groups.index(field) + 1])
    return out.otherwise(F.lit(""))


def level_of(fmt: Column, raw: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for kv in P.LETTER_LEVELS.items() for x in kv])
    upper = F.upper(raw)
    return F.when(fmt == "syslog", F.lit("INFO")).otherwise(F.coalesce(F.try_element_at(letters, upper), upper))


def continuation(raw: Column) -> Column:
    """The lines after the first without box borders."""
    rest = F.transform(F.slice(F.split(raw, "\n"), 2, 1 << 30), lambda x: F.trim(x))
    rest = F.filter(rest, lambda x: (x != "") & ~x.rlike("^[┌└─]"))
    return F.array_join(F.transform(rest, lambda x: F.when(x.rlike(r"^[│|]"), F.trim(F.substring(x, 2, 1 << 30))).otherwise(x)), "\n")


def frames(raw: Column) -> Column:
    """Frames of a Python traceback: file, line, function, and the source line below."""
    lines = F.split(raw, r"\r\n|\n|\r")
    at = lambda i: F.trim(F.coalesce(F.try_element_at(lines, i + 2), F.lit("")))
    row = lambda x, i: F.when(
        x.rlike(P.PYTHON_FRAME), F.struct(F.regexp_extract(x, P.PYTHON_FRAME, 1).alias("file"), F.regexp_extract(x, P.PYTHON_FRAME, 2).try_cast("int").alias("line"), F.regexp_extract(x, P.PYTHON_FRAME, 3).alias("function"), at(i).alias("source"))
    )
    return F.filter(F.transform(lines, row), lambda x: x.isNotNull())


def error_line(raw: Column) -> Column:
    """The last line that names an error, trimmed; null if none does."""
    lines = F.filter(F.split(raw, r"\r\n|\n|\r"), lambda x: ~x.rlike(P.PYTHON_FRAME))
    return F.try_element_at(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(P.PYTHON_ERROR)), F.lit(-1))


def entries(raw_rows: DataFrame) -> DataFrame:
    """Adds to (…, raw) the fields of a log entry: message, level, timestamp, logger, module, function, pathname, lineno,
    exception_type, stack_frames and fields. Missing strings are empty."""
    first = F.element_at(F.split("raw", r"\r\n|\n|\r"), 1)
    df = raw_rows.withColumn("first", first)
    df = df.withColumn("json", F.when(F.trim("first").rlike(r"^\{.*\}$"), F.from_json("first", "map<string,string>")))
    df = df.withColumn("match", F.when(F.col("json").isNotNull(), F.array(F.lit("json"))).otherwise(plain_match(F.col("first"))))
    df = settled(df).withColumn("fmt", F.col("match")[0])
    line, fmt, j = F.col("first"), F.col("fmt"), F.col("json")
    pick = lambda names, plain: F.when(fmt == "json", F.coalesce(truthy(j, *names), F.lit(""))).otherwise(plain)
    plain = {f: plain_field(F.col("match"), f) for f in ("ts", "level", "logger", "msg", "pid", "tid", "thread", "package")}
    df = df.withColumns(
        {
            "message": pick(("message", "msg", "event"), F.when(fmt == "", line).otherwise(F.trim(plain["msg"]))),
            "level": pick(("level", "levelname"), level_of(fmt, plain["level"])),
            "timestamp": pick(("timestamp", "time"), plain["ts"]),
            "logger": pick(("logger", "name"), F.trim(plain["logger"])),
            "module": pick(("module",), F.lit("")),
            "function": pick(("function", "funcName"), F.lit("")),
            "pathname": pick(("pathname", "file"), F.lit("")),
            "lineno": F.when(fmt == "json", truthy(j, "lineno", "line").try_cast("int")),
            "fields": F.when(fmt == "json", j).when(
                ~fmt.isin("", "syslog"), F.map_filter(F.create_map(*[x for k in ("ts", "pid", "tid", "thread", "package", "logger", "level", "msg") for x in (F.lit(k), plain[k])]), lambda k, v: v != "")
            ),
            "stack_frames": F.when(F.contains("raw", F.lit('File "')), frames(F.col("raw"))).otherwise(F.array().cast("array<struct<file:string,line:int,function:string,source:string>>")),
            "error": F.when(F.contains("raw", F.lit('File "')), error_line(F.col("raw"))),
        }
    )
    df = settled(df.withColumn("level", F.upper("level")))
    df = df.withColumn("message", F.when((F.col("message") == "") & F.contains("raw", F.lit("\n")), continuation(F.col("raw"))).otherwise(F.col("message")))
    traced = (F.size("stack_frames") > 0) & F.col("error").isNotNull()
    said = F.regexp_extract("error", P.PYTHON_ERROR, 2)
    said = F.when(said == "", F.col("error")).otherwise(said)
    df = df.withColumn("exception_type", F.when(traced, F.regexp_extract("error", P.PYTHON_ERROR, 1)).otherwise(F.lit("")))
    df = df.withColumn("message", F.when(traced & ((F.col("message") == "") | (F.col("message") == F.col("first"))), said).otherwise(text_or_empty("message")))
    return settled(df.drop("first", "json", "match", "error"))
