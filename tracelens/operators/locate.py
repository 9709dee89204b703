"""Ranking the source functions that may have written a log entry: evidence by joins, summed and cut to the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.frames import reused
from ..functions.text import canonical, file_name, is_generic, keywords, matching_ratio, message_keywords, normalize, quick_similarity, same_file, settled

EVIDENCE = ["entry_id", "function_id", "score", "reason", "line", "log_site_id", "stage", "ord"]


def evidence(df: DataFrame, score: Column, reason: Column, line: Column | None, site: Column | None, stage: int, order: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "entry_id", "function_id", score.cast("double").alias("score"), reason.alias("reason"), (none if line is None else line).cast("int").alias("line"),
        (none if site is None else site).cast("string").alias("log_site_id"), F.lit(stage).alias("stage"), (F.lit("") if order is None else order).cast("string").alias("ord"),
    )


def named(functions: DataFrame) -> DataFrame:
    return functions.withColumnRenamed("id", "function_id").select("function_id", "name", "qualname", "module", F.col("file").alias("f_file"), "start_line", "end_line")


def structured(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Entries that name a file or a function themselves."""
    e = entries.select("entry_id", "pathname", "function", "lineno")
    f = named(functions)
    keyed = f.select(F.explode(F.array_distinct(F.filter(F.array(F.concat(F.lit("p:"), file_name(F.col("f_file"))), F.when(F.length("name") >= 3, F.concat(F.lit("n:"), F.lower("name"))), F.concat(F.lit("q:"), "qualname")), lambda x: x.isNotNull()))).alias("key"), "*")
    asked = F.array(F.when(F.col("pathname") != "", F.concat(F.lit("p:"), file_name(F.col("pathname")))), F.when(F.col("function") != "", F.concat(F.lit("n:"), F.lower("function"))), F.when(F.col("function") != "", F.concat(F.lit("q:"), "function")))
    pairs = e.select("*", F.explode(F.filter(asked, lambda x: x.isNotNull())).alias("key")).join(keyed, "key").drop("key").dropDuplicates(["entry_id", "function_id"])
    ok = ((F.col("pathname") == "") | same_file(F.col("f_file"), F.col("pathname"))) & ((F.col("function") == "") | F.col("function").isin(F.col("name"), F.col("qualname")) | (F.col("function") == F.concat_ws(".", "module", "qualname")))
    inside = F.coalesce(F.col("lineno").between(F.col("start_line"), F.col("end_line")) & (F.col("lineno") != 0), F.lit(False))
    return evidence(pairs.filter(ok), P.STRUCTURED + F.when(inside, P.STRUCTURED_IN_RANGE).otherwise(0.0), F.lit("structured file/function/line evidence"), F.col("lineno"), None, 1)


def framed(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions named by frames of a traceback; the last frame weighs most."""
    e = entries.filter(F.size("stack_frames") > 0).select("entry_id", F.size("stack_frames").alias("n"), F.posexplode("stack_frames").alias("pos", "frame"))
    f = named(functions).withColumn("base", file_name(F.col("f_file")))
    e = e.withColumn("base", file_name(F.col("frame.file")))
    pairs = e.join(f, "base").filter(F.col("frame.function").isin(F.col("name"), F.element_at(F.split("qualname", r"\."), -1)))
    weight = F.when(F.col("pos") == F.col("n") - 1, P.LAST_FRAME).otherwise(P.OTHER_FRAME)
    bonus = F.when(F.col("frame.line").between(F.col("start_line"), F.col("end_line")), P.FRAME_IN_RANGE).otherwise(0.0)
    reason = F.concat(F.lit("traceback frame "), "base", F.lit(":"), F.col("frame.line").cast("string"), F.lit(" in "), F.col("frame.function"))
    return evidence(pairs, weight + bonus, reason, F.col("frame.line"), None, 2, F.lpad(F.col("pos").cast("string"), 6, "0"))


def sites_with_keywords(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Log sites that can match: of a known function and not without any literal word."""
    s = sites.select(F.col("id").alias("site_id"), "function_id", F.col("level").alias("site_level"), "template", "regex", F.col("file").alias("site_file"), F.col("line").alias("site_line"))
    s = s.withColumn("kw", keywords(F.col("template"))).filter((F.size("kw") > 0) | ~is_generic(F.col("template")))
    return s.join(named(functions).select("function_id", "qualname", "module"), "function_id")


def candidate_pairs(messages: DataFrame, sites: DataFrame) -> DataFrame:
    """(message, site) pairs that share a keyword, by an inverted index; entries or sites without keywords, and the shortest
    templates, meet everything through a key of their own. ``messages`` needs (msg_id, norm)."""
    m = messages.withColumn("mkw", message_keywords(F.col("norm")))
    free = (F.size("kw") == 0) | (F.length("template") <= 3)
    mk = m.select("msg_id", F.explode(F.concat(F.when(F.size("mkw") > 0, F.col("mkw")).otherwise(F.array(F.lit("*none"))), F.array(F.lit("*free")))).alias("key"))
    sk = sites.select("site_id", F.explode(F.when(free, F.array(F.lit("*free"))).otherwise(F.concat("kw", F.array(F.lit("*none"))))).alias("key"))
    return mk.join(sk, "key").select("msg_id", "site_id").distinct()


def templated(entries: DataFrame, sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Logger templates that a message fits, exactly or nearly. Equal messages are matched once."""
    s = reused(settled(sites_with_keywords(sites, functions).withColumn("a", canonical(F.col("template")))))
    e = entries.select("entry_id", F.when(F.col("message") != "", F.col("message")).otherwise(F.col("raw")).alias("msg"), "level", "logger").withColumn("msg_id", F.md5("msg"))
    distinct = settled(e.select("msg_id", "msg").dropDuplicates(["msg_id"]).withColumn("norm", normalize(F.col("msg"))))
    distinct = reused(settled(distinct.withColumn("b", canonical(F.col("norm")))))
    pairs = candidate_pairs(distinct, s).join(distinct, "msg_id").join(s.select("site_id", "template", "regex", "a"), "site_id")
    pairs = reused(settled(pairs.withColumn("hit", (F.col("regex") != "") & F.expr("norm rlike regex"))))
    exact = pairs.filter("hit").select("msg_id", "site_id", F.lit(None).cast("double").alias("sim"))
    la, lb = F.length("msg"), F.length("template")
    near = pairs.filter("not hit").filter((la > 15) & (lb > 15) & (F.abs(la - lb) < F.greatest(la, lb) * 0.5))
    near = near.withColumn("q", F.when(F.col("norm") == F.col("template"), F.lit(1.0)).otherwise(quick_similarity(F.col("a"), F.col("b"))))
    near = settled(near)
    decided = near.filter("q is not null").select("msg_id", "site_id", F.col("q").alias("sim"))
    slow = near.filter("q is null").select("msg_id", "site_id", matching_ratio("a", "b").alias("sim"))
    fuzzy = decided.unionAll(slow).filter(F.col("sim") >= P.FUZZY_LEAST)
    found = e.join(exact.unionAll(fuzzy), "msg_id").join(s, "site_id")
    level = (F.col("level") != "") & (F.col("site_level") != "") & F.startswith(F.lower("level"), F.lower(F.substring("site_level", 1, 4)))
    logger = (F.col("logger") != "") & (F.contains("module", F.col("logger")) | F.contains("qualname", F.col("logger")))
    score = F.when(F.col("sim").isNull(), P.TEMPLATE + F.when(level, P.TEMPLATE_LEVEL).otherwise(0.0) + F.when(logger, P.TEMPLATE_LOGGER).otherwise(0.0)).otherwise(P.FUZZY_BASE + P.FUZZY_SCALE * F.col("sim"))
    reason = F.when(F.col("sim").isNull(), F.concat(F.lit("template match: '"), "template", F.lit("'"))).otherwise(F.concat(F.lit("fuzzy template similarity "), F.format_string("%.2f", "sim"), F.lit(": '"), "template", F.lit("'")))
    order = F.concat_ws("|", "site_file", F.lpad(F.col("site_line").cast("string"), 9, "0"), "site_id")
    return evidence(found, score, reason, F.col("site_line"), F.col("site_id"), 3, order)


def mentioned(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Function and module names among the words of an entry."""
    hay = F.lower(F.concat_ws(" ", "raw", "logger", "module"))
    w = entries.select("entry_id", F.explode(F.array_distinct(F.regexp_extract_all(hay, F.lit("([a-z一-鿿]{3,})"), F.lit(1)))).alias("word"))
    f = named(functions)
    by_name = w.join(f.filter(F.length("name") >= 3).withColumn("word", F.lower("name")), "word")
    by_module = w.join(f.filter(F.length("module") >= 3).withColumn("word", F.lower("module")), "word")
    return evidence(by_name, F.lit(P.NAME_SEEN), F.lit("function name appears in log evidence"), None, None, 4).unionAll(evidence(by_module, F.lit(P.MODULE_SEEN), F.lit("module name appears in log evidence"), None, None, 5))


def neighbours(entries: DataFrame, scored: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates one call away from a function that a traceback names; once for callers and once for callees."""
    frames = entries.select("entry_id", F.explode("stack_frames").alias("f")).select("entry_id", F.col("f.function").alias("name")).distinct()
    known = functions.select("id", "name")
    calls = edges.join(known.select(F.col("id").alias("caller"), F.col("name").alias("caller_name")), "caller").join(known.select(F.col("id").alias("callee"), F.col("name").alias("callee_name")), "callee")
    cand = scored.select("entry_id", "function_id").distinct()
    up = cand.join(calls.select(F.col("callee").alias("function_id"), F.col("caller_name").alias("name")), "function_id").join(frames, ["entry_id", "name"]).select("entry_id", "function_id").distinct()
    down = cand.join(calls.select(F.col("caller").alias("function_id"), F.col("callee_name").alias("name")), "function_id").join(frames, ["entry_id", "name"]).select("entry_id", "function_id").distinct()
    reason = F.lit("call graph neighbor appears in traceback")
    return evidence(up, F.lit(P.NEIGHBOUR), reason, None, None, 6).unionAll(evidence(down, F.lit(P.NEIGHBOUR), reason, None, None, 7))


def summed(ev: DataFrame) -> DataFrame:
    """(entry_id, function_id, score, reasons, line, log_site_id): evidence added up; the last site's line counts, else the last line."""
    ranked = F.struct("stage", "ord")
    return ev.groupBy("entry_id", "function_id").agg(
        F.sum("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("stage", "ord", "reason"))), lambda x: x["reason"]).alias("reasons"),
        F.max_by(F.when(F.col("log_site_id").isNotNull(), F.struct("log_site_id", "line")), F.when(F.col("log_site_id").isNotNull(), ranked)).alias("site"),
        F.max_by("line", F.when(F.col("line").isNotNull() & (F.col("line") != 0), ranked)).alias("any_line"),
    )


def adjacency(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, callers) and (id, callees), sorted and distinct; unresolved callees stay by name."""
    ids = functions.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi")
    callees = inner.groupBy(F.col("caller").alias("id")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    callers = inner.join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi").groupBy(F.col("callee").alias("id")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    return callers, callees


def top_candidates(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("entry_id").orderBy(F.desc("score"), "file", "line", "function_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def locate(entries: DataFrame, index: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """Ranked candidates of each entry: rank, score, function, file, line, reasons, site, callers and callees."""
    functions, edges, sites = reused(index["functions"]), reused(index["call_edges"]), index["log_sites"]
    entries = reused(entries)
    ev = structured(entries, functions).unionAll(framed(entries, functions)).unionAll(templated(entries, sites, functions)).unionAll(mentioned(entries, functions))
    ev = reused(ev)
    ev = ev.unionAll(neighbours(entries, ev, functions, edges))
    scored = summed(ev).join(functions.select(F.col("id").alias("function_id"), F.col("qualname").alias("function"), "file", "start_line"), "function_id")
    scored = scored.withColumn("line", F.coalesce("site.line", "any_line", "start_line")).withColumn("log_site_id", F.col("site.log_site_id"))
    callers, callees = adjacency(functions, edges)
    best = top_candidates(scored, top)
    out = best.join(callers.withColumnRenamed("id", "function_id"), "function_id", "left").join(callees.withColumnRenamed("id", "function_id"), "function_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("entry_id", "rank", "score", "function_id", "function", "file", "line", "reasons", "log_site_id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def correct(found_file: Column, found_function: Column, found_line: Column, file: Column, function: Column, line: Column, tolerance: int = 3) -> Column:
    """Whether a candidate is the expected place: same file, same function or its last part, and a near line."""
    same = (found_function == function) | F.endswith(found_function, F.concat(F.lit("."), function))
    return same_file(found_file, file) & same & (F.coalesce(line, F.lit(0)).isin(0) | (F.abs(found_line - line) <= tolerance))


def evaluate(corpus: DataFrame, parsed: DataFrame, index: dict[str, DataFrame], top: int = 3, tolerance: int = 3) -> DataFrame:
    """(id, top1, hit): whether a labelled case's place is the first, or among the first ``top``, candidates."""
    found = locate(parsed, index, top)
    e = corpus.select(F.col("id").alias("entry_id"), "expected")
    ok = F.coalesce(correct(F.col("file"), F.col("function"), F.col("line"), F.col("expected.file"), F.col("expected.function"), F.col("expected.line"), tolerance), F.lit(False))
    return e.join(found, "entry_id", "left").groupBy(F.col("entry_id").alias("id")).agg(F.max(ok & (F.col("rank") == 1)).alias("top1"), F.max(ok).alias("hit")).select("id", F.coalesce("top1", F.lit(False)).alias("top1"), F.coalesce("hit", F.lit(False)).alias("hit"))
