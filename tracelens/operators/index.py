"""The code index as tables: resolving calls, keeping it current, and cutting out a focus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_edges(edges: DataFrame, functions: DataFrame, distinct_names: bool = False) -> DataFrame:
    """Callees by function id where a name has one meaning: the raw name if it is known at all, else its last part.

    A function is known by name, qualified name and module with qualified name; a top-level function's name and qualified
    name are equal and count twice, so that it only resolves through its module, unless ``distinct_names``. Adds the raw
    name, from which a later build resolves again."""
    names = F.array("name", "qualname", F.concat_ws(".", "module", "qualname"))
    keys = functions.select("id", F.explode(F.array_distinct(names) if distinct_names else names).alias("key"))
    known = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("target"))
    raw = edges.withColumn("raw", F.coalesce("raw", "callee") if "raw" in edges.columns else F.col("callee")).withColumn("tail", F.element_at(F.split("raw", r"\."), -1))
    by_raw = known.select(F.col("key").alias("raw"), F.col("c").alias("c1"), F.col("target").alias("t1"))
    by_tail = known.select(F.col("key").alias("tail"), F.col("c").alias("c2"), F.col("target").alias("t2"))
    out = raw.join(by_raw, "raw", "left").join(by_tail, "tail", "left")
    target = F.when(F.col("c1").isNotNull(), F.when(F.col("c1") == 1, F.col("t1"))).when(F.col("c2") == 1, F.col("t2"))
    out = out.withColumn("target", target)
    keep = [c for c in edges.columns if c not in ("callee", "confidence", "raw")]
    return out.select(*keep, F.coalesce("target", "raw").alias("callee"), "raw", F.when(F.col("target").isNotNull(), 0.9).otherwise(F.col("confidence")).alias("confidence"))


def changes(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse (new or changed) and files whose rows go (changed or gone), by signature."""
    same = ["file", "signature"]
    return now.join(before.select(*same), same, "left_anti"), before.join(now.select(*same), same, "left_anti")


def without_files(index: dict[str, DataFrame], stale: DataFrame) -> dict[str, DataFrame]:
    """An index without the rows of stale files; calls into removed functions go back to their raw names."""
    gone = stale.select("file").distinct()
    out = {k: t.join(gone, "file", "left_anti") for k, t in index.items()}
    if "raw" in index["call_edges"].columns:
        out["call_edges"] = out["call_edges"].withColumn("callee", F.col("raw"))
    return out


def merged(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Union of two indexes; of equal ids the new one's row counts. Calls are resolved again over all functions."""
    out = {}
    for k in new:
        both = old[k].withColumn("__new", F.lit(0)).unionByName(new[k].withColumn("__new", F.lit(1)), allowMissingColumns=True)
        if k in ("functions", "log_sites"):
            both = both.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__new")))).filter("__r = 1").drop("__r")
        out[k] = both.drop("__new")
    out["call_edges"] = resolve_edges(out["call_edges"], out["functions"])
    return out


def focus(candidates: DataFrame, functions: DataFrame, edges: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Candidates with their first callers and known callees, and the calls among all these."""
    ids = functions.select("id")
    cand = candidates.select(F.col("function_id").alias("id")).distinct().join(ids, "id", "left_semi")
    inner = edges.select("caller", "callee").distinct().join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")

    def side(a: str, b: str) -> DataFrame:
        near = inner.join(cand.withColumnRenamed("id", a), a, "left_semi")
        return near.withColumn("r", F.row_number().over(Window.partitionBy(a).orderBy(b))).filter(F.col("r") <= limit).select(F.col(b).alias("id"))

    nodes = cand.unionAll(side("callee", "caller")).unionAll(side("caller", "callee")).distinct()
    kept = inner.join(nodes.withColumnRenamed("id", "caller"), "caller", "left_semi").join(nodes.withColumnRenamed("id", "callee"), "callee", "left_semi")
    return nodes, kept
