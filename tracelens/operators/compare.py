"""Comparing a good run with a failing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ranked, reused
from .events import duration_stats


def among(a: Column, items: Column) -> Column:
    """Items of ``a`` that are in ``items``, repeats and order kept. A list built inside the filter would be built again for
    each item; the variable of an outer lambda holds it."""
    return F.transform(F.array(items), lambda known: F.filter(a, lambda x: F.array_contains(known, x)))[0]


def shared(a: Column, b: Column) -> Column:
    """Items of ``a`` that ``b`` has, repeats and order kept."""
    return among(a, F.array_intersect(a, b))  # each label once, however long the lists are


def lacking(a: Column, b: Column) -> Column:
    """Items of ``a`` that ``b`` lacks, repeats and order kept."""
    return among(a, F.array_except(a, b))


def run_labels(labels: Column) -> Column:
    """``labels`` of all timelines, the largest timeline first, as one list."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("event_count")).alias("n"), "session_id", labels.alias("labels"))))
    return F.flatten(F.transform(ranked, lambda x: x["labels"]))


def compare_labels(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """One row: labels shared, missing in the target, and extra there, over all timelines. Each timeline is held against the
    other run's distinct labels by itself; only what is listed is gathered."""
    runs = [reused(run) for run in (baseline, target)]
    b_has, t_has = (F.broadcast(run.select(F.explode("labels").alias("x")).distinct().agg(F.collect_list("x").alias("has"))) for run in runs)  # one row each
    has = lambda x: F.array_contains("has", x)
    b = runs[0].crossJoin(t_has).agg(run_labels(F.filter("labels", has)).alias("shared"), run_labels(F.filter("labels", lambda x: ~has(x))).alias("missing"))
    t = runs[1].crossJoin(b_has).agg(run_labels(F.filter("labels", lambda x: ~has(x))).alias("extra"))
    return b.crossJoin(t)  # one row each


def compare_sessions(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Sessions of both runs: paired by id, else by rank, else alone; with what each pair misses and has besides.

    A target may be paired by rank although its own id has a partner. Rank: events descending, then id."""
    b = ranked(reused(baseline), "rank", "event_count", "session_id").select(F.col("session_id").alias("b_id"), F.col("labels").alias("b_labels"), "rank")
    t = reused(ranked(reused(target), "t_rank", "event_count", "session_id").select(F.col("session_id").alias("t_id"), F.col("labels").alias("t_labels"), "t_rank"))
    by_id = b.join(t.select("t_id", "t_labels"), b["b_id"] == t["t_id"], "left")
    by_rank = t.select(F.col("t_rank").alias("rank"), F.col("t_id").alias("r_id"), F.col("t_labels").alias("r_labels"))
    paired = reused(by_id.join(by_rank, "rank", "left")).select("rank", "b_id", "b_labels", F.coalesce("t_id", "r_id").alias("t_id"), F.coalesce("t_labels", "r_labels").alias("t_labels"))
    rest = t.join(paired.select("t_id"), "t_id", "left_anti").select((F.col("t_rank") + 1_000_000_000).alias("rank"), F.lit("").alias("b_id"), F.array().cast("array<string>").alias("b_labels"), "t_id", "t_labels")
    both = paired.unionAll(rest)
    none = F.array().cast("array<string>")
    tl = F.coalesce("t_labels", none)
    return both.select(
        "rank", F.col("b_id").alias("baseline_session"), F.coalesce("t_id", F.lit("")).alias("target_session"), shared(F.col("b_labels"), tl).alias("shared"),
        lacking(F.col("b_labels"), tl).alias("missing"), lacking(tl, F.col("b_labels")).alias("extra"), tl.alias("target_labels"),
    )


def duration_anomalies(baseline: DataFrame, target: DataFrame, ratio: float = 2.0, delta: float = 500.0) -> DataFrame:
    """Labels whose mean duration grew by the factor and by the milliseconds at least; sort by -ratio, -delta. Takes events."""
    b = duration_stats(baseline).select("label", F.col("avg_ms").alias("baseline_avg_ms"))
    t = duration_stats(target).select("label", F.col("avg_ms").alias("target_avg_ms"))
    both = t.join(b, "label").filter("baseline_avg_ms > 0")
    out = both.withColumn("ratio", F.col("target_avg_ms") / F.col("baseline_avg_ms")).withColumn("delta_ms", F.col("target_avg_ms") - F.col("baseline_avg_ms"))
    return out.filter((F.col("ratio") >= ratio) & (F.col("delta_ms") >= delta))
