"""Classification of log entries into runtime events, and what sessions, durations and vocabulary they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import normalize, number_text, settled


def first_pattern(text: Column, items: list[dict]) -> Column:
    """Type of the first profile pattern that a normalised lower-case text holds; null if none."""
    out = None
    for item in items:
        pattern = str(item.get("pattern") or "").lower()
        if pattern:
            out = (F if out is None else out).when(F.contains(text, F.lit(pattern)), F.lit(str(item.get("type") or f"project:{pattern}")))
    return F.lit(None).cast("string") if out is None else out


def event_type(text: Column, low: Column, level: Column, exception_type: Column, profile: dict | None = None) -> Column:
    """``low``: the text normalised in lower case. Exception, then manual patterns, then the fixed rules, then learned patterns, then the level; empty if nothing applies."""
    learned = (profile or {}).get("learned_patterns", [])
    rules = F
    for name, pattern in P.EVENT_RULES:
        rules = rules.when(text.rlike(pattern), F.lit(name))
    return F.coalesce(
        F.when(exception_type != "", F.lit("exception")),
        first_pattern(low, [x for x in learned if x.get("source") == "manual_profile"]),
        rules.otherwise(F.lit(None)),
        first_pattern(low, learned),
        F.when(F.upper(level).isin(P.ERROR_LEVELS), F.lit("error")),
        F.lit(""),
    )


def quoted(key: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in key)


def session(text: Column, profile: dict | None = None) -> tuple[Column, Column]:
    """Key as written and value of the first session field, profile keys first; empty if there is none."""
    found = [rf"(?iU)\b({quoted(str(k))})\b\s*[=:]\s*([A-Za-z0-9_.:-]+)" for k in (profile or {}).get("session_keys", [])] + [P.SESSION]
    return tuple(F.coalesce(*[F.nullif(F.regexp_extract(text, p, n), F.lit("")) for p in found], F.lit("")) for n in (1, 2))


def state(text: Column, profile: dict | None = None) -> Column:
    """A profile state in the text, else what follows state or a verb of entering; empty if there is none."""
    known = [F.when(F.contains(text, F.lit(str(s))), F.lit(str(s))) for s in (profile or {}).get("states", []) if str(s)]
    return F.coalesce(*known, *[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in P.STATES], F.lit(""))


def duration_ms(text: Column) -> Column:
    value = F.regexp_extract(text, P.DURATION, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, P.DURATION, 2))
    return F.when(unit.isin("s", "sec", "seconds", "秒"), value * 1000).otherwise(value)


def label(kind: Column, profile: dict | None = None) -> Column:
    """Short name of an event type: of project types the manual event's name, else what follows the colon."""
    out = F
    for name, spec in ((profile or {}).get("events") or {}).items():
        kinds = [f"project:{name}"] + ([f"project:{spec['type']}"] if isinstance(spec, dict) and spec.get("type") else [])
        out = out.when(kind.isin(kinds), F.lit(name))
    tail = F.regexp_replace(kind, "^project:", "")
    return tail if out is F else out.otherwise(tail)


def events(parsed: DataFrame, profile: dict | None = None) -> DataFrame:
    """Entries that are events: file, line, type, label, message, …, session_key, session_id, state, duration_ms, evidence."""
    text = F.concat_ws(" ", "message", "raw")
    key, value = session(F.col("text"), profile)
    df = settled(parsed.withColumn("text", text).withColumn("low", F.lower(normalize(text))))
    df = settled(df.withColumn("type", event_type(F.col("text"), F.col("low"), F.col("level"), F.col("exception_type"), profile))).filter("type <> ''")
    df = df.withColumns({"session_key": key, "session_id": value, "state": state(F.col("text"), profile), "duration_ms": duration_ms(F.col("text"))})
    df = settled(df)
    parts = [
        F.when(F.col("exception_type") != "", F.concat(F.lit("exception="), "exception_type")),
        F.when(F.col("duration_ms").isNotNull(), F.concat(F.lit("duration_ms="), number_text(F.col("duration_ms")))),
        F.when(F.col("state") != "", F.concat(F.lit("state="), "state")),
        F.when(F.col("session_id") != "", F.concat_ws("=", "session_key", "session_id")),
    ]
    df = df.withColumn("evidence", F.filter(F.array(*parts), lambda x: x.isNotNull())).withColumn("label", label(F.col("type"), profile))
    return df.select("file", F.col("line_no").alias("line"), "type", "label", "message", "timestamp", "level", "logger", "session_key", "session_id", "state", "duration_ms", "evidence")


def type_counts(ev: DataFrame) -> DataFrame:
    """(type, n, first_line): in order of first occurrence when sorted by ``first_line``."""
    return ev.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def top_sessions(ev: DataFrame, limit: int = 10) -> DataFrame:
    """Sessions with the most events; of equals the one seen first."""
    counts = ev.filter("session_id <> ''").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))
    return counts.orderBy(F.desc("n"), "first_line").limit(limit)


def timelines(ev: DataFrame) -> DataFrame:
    """One row per session: key, events, counts by type, and labels in order of lines. Events without a session form one
    timeline of their own, but only where no session exists at all."""
    any_session = ev.select(F.coalesce(F.max(F.col("session_id") != ""), F.lit(False)).alias("any_session"))
    keyed = ev.crossJoin(F.broadcast(any_session)).filter("session_id <> '' or not any_session")  # one row
    keyed = keyed.select(F.when(F.col("session_id") == "", F.lit("__global__")).otherwise(F.col("session_id")).alias("session_id"), "line", "session_key", "type", "label")
    ordered = keyed.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line", "session_key", "type", "label"))).alias("rows"))
    types = F.transform("rows", lambda x: x["type"])
    counts = F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).cast("bigint").alias("n")))
    first = F.col("rows")[0]
    return ordered.select(
        "session_id", first["session_key"].alias("session_key"), F.size("rows").cast("bigint").alias("event_count"), F.map_from_entries(counts).alias("event_types"),
        F.transform("rows", lambda x: x["label"]).alias("labels"), first["line"].alias("first_line"),
    )


def missing_of(labels: Column, expected: Column) -> Column:
    """Expected labels that a greedy walk through the observed ones doesn't meet in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("absent"))

    def step(acc: Column, x: Column) -> Column:
        found = F.array_position(F.slice(labels, acc["at"] + 1, F.size(labels) + 1), x).cast("int")
        met = F.struct((acc["at"] + found).alias("at"), acc["absent"].alias("absent"))
        return F.when(found > 0, met).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["absent"], F.array(x)).alias("absent")))

    return F.aggregate(expected, start, step, lambda acc: acc["absent"])


def missing_events(lines: DataFrame, sequences: dict[str, list[str]]) -> DataFrame:
    """(session_id, sequence, missing, observed) of timelines that hold a sequence's first label but not all of it in order."""
    spark = lines.sparkSession
    rows = [(i, name, [str(x) for x in seq]) for i, (name, seq) in enumerate(sequences.items()) if isinstance(seq, list) and seq]
    known = spark.createDataFrame(rows, "ord int, sequence string, expected array<string>")
    out = lines.join(F.broadcast(known), F.expr("array_contains(labels, expected[0])"))  # as many rows as the profile has sequences
    out = out.withColumn("missing", missing_of(F.col("labels"), F.col("expected"))).filter(F.size("missing") > 0)
    return out.select("session_id", "sequence", "missing", F.col("labels").alias("observed"), "ord", "event_count")


def duration_stats(ev: DataFrame) -> DataFrame:
    """(label, count, min_ms, max_ms, avg_ms) by state or else label; sort by -avg_ms, label."""
    name = F.coalesce(F.nullif(F.col("state"), F.lit("")), F.col("label"))
    timed = ev.filter("duration_ms is not null").groupBy(name.alias("name"))
    return timed.agg(F.count(F.lit(1)).alias("count"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.avg("duration_ms").alias("avg_ms")).withColumnRenamed("name", "label")


def words(text: Column, blanked: str) -> Column:
    return F.regexp_extract_all(F.lower(normalize(F.regexp_replace(text, blanked, " "))), F.lit(f"({P.WORD})"), F.lit(1))


def suggested_rules(ev: DataFrame, limit: int = 8) -> DataFrame:
    """(pattern, count, example): the most frequent words of messages that occur twice at least."""
    tokens = ev.select("line", "message", "session_id", F.posexplode(words(F.col("message"), P.BLANKED)).alias("pos", "pattern"))
    tokens = tokens.filter(~F.col("pattern").isin(P.SUGGESTION_STOP) & (F.col("pattern") != F.lower("session_id")))
    ranked = tokens.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("line", "pos", "message")).alias("seen"))
    return ranked.orderBy(F.desc("count"), "seen.line", "seen.pos").limit(limit).filter("count >= 2").select("pattern", "count", F.col("seen.message").alias("example"))


def vocabulary(sites: DataFrame, max_patterns: int = 80) -> DataFrame:
    """(pattern, type, count, log_sites, example, ord): words of templates, the most frequent first. ``sites`` needs (ord, template)."""
    tokens = sites.select("ord", "template", F.posexplode(words(F.col("template"), P.TEMPLATE_BLANKED)).alias("pos", "pattern"))
    tokens = tokens.filter(~F.col("pattern").isin(P.VOCABULARY_STOP) & (F.length("pattern") >= 3))
    keys = sites.select(F.explode(F.regexp_extract_all("template", F.lit(P.TEMPLATE_KEY), F.lit(1))).alias("k")).select(F.lower("k").alias("pattern")).distinct()
    ranked = tokens.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("ord").alias("log_sites"), F.min(F.struct("ord", "pos", "template")).alias("seen"))
    top = ranked.orderBy(F.desc("count"), "seen.ord", "seen.pos").limit(max_patterns)
    out = top.join(keys, "pattern", "left_anti")
    return out.select("pattern", F.concat(F.lit("project:"), "pattern").alias("type"), "count", "log_sites", F.col("seen.template").alias("example"), F.row_number().over(Window.orderBy(F.desc("count"), "seen.ord", "seen.pos")).alias("ord"))


def ranked_names(values: DataFrame, limit: int) -> list[str]:
    """Most frequent names of (ord, pos, name), first seen first among equals."""
    rows = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("seen")).orderBy(F.desc("n"), "seen").limit(limit).collect()
    return [r["name"] for r in rows]


def learned_profile(sites: DataFrame) -> dict:
    """The vocabulary profile of indexed log sites: bounded lists, gathered on the driver."""
    ordered = sites.withColumn("ord", F.struct("file", "line", "id"))
    every = lambda pattern, n: ordered.select("ord", F.posexplode(F.regexp_extract_all("template", F.lit(pattern), F.lit(n))).alias("pos", "name"))
    patterns = vocabulary(ordered).orderBy("ord").collect()
    return {
        "version": 1, "source": "indexed_log_templates", "log_site_count": sites.count(),
        "learned_patterns": [{k: r[k] for k in ("pattern", "type", "count", "log_sites", "example")} for r in patterns],
        "session_keys": ranked_names(every(P.TEMPLATE_KEY, 1), 20), "states": ranked_names(every(P.TEMPLATE_STATE, 0), 40),
        "loggers": ranked_names(ordered.filter("logger <> ''").select("ord", F.lit(0).alias("pos"), F.col("logger").alias("name")), 40),
    }
