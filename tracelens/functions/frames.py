"""Steps over whole tables that operators share: reuse of a table, running sums and ranks without one task for all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a file that one task sums up.
STRETCH = 100_000


def reused(df: DataFrame) -> DataFrame:
    """A table that several later steps read, computed once. Lost blocks are computed again from their lineage."""
    return df if df.is_cached else df.persist(StorageLevel.MEMORY_AND_DISK)


def numbered_by(df: DataFrame, name: str, amount: str) -> DataFrame:
    """Adds ``name``, the sum of ``amount`` over a file's lines up to each. Sums of stretches come first; their own running
    sum has one row a stretch, and each stretch is then summed by itself."""
    split = df.withColumn("__stretch", F.floor(F.col("line_no") / STRETCH))
    sums = split.groupBy("file", "__stretch").agg(F.sum(amount).alias("__sum"))
    ahead = Window.partitionBy("file").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("file", "__stretch", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("file", "__stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return split.join(offsets, ["file", "__stretch"]).withColumn(name, F.col("__before") + F.sum(amount).over(inside)).drop("__stretch", "__before")


def carried(df: DataFrame, name: str, value: str) -> DataFrame:
    """Adds ``name``, the last non-null ``value`` of a file's lines up to each, by stretches like :func:`numbered_by`."""
    split = df.withColumn("__stretch", F.floor(F.col("line_no") / STRETCH))
    lasts = split.groupBy("file", "__stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_no"))).alias("__last"))
    ahead = Window.partitionBy("file").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lasts.select("file", "__stretch", F.last("__last", ignorenulls=True).over(ahead).alias("__before"))
    inside = Window.partitionBy("file", "__stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return split.join(offsets, ["file", "__stretch"]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__before")).drop("__stretch", "__before")


def ranked(df: DataFrame, name: str, amount: str, key: str, prefix: int = 6) -> DataFrame:
    """Adds ``name``, the rank of rows by ``amount`` descending, then ``key``. Rows are ranked within groups of one amount and
    one beginning of the key; only the groups' sizes are put in order together."""
    begin = F.substring(F.col(key), 1, prefix)
    grouped = df.withColumn("__begin", begin)
    sizes = grouped.groupBy(amount, "__begin").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy(F.desc(amount), "__begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(amount, "__begin", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(amount, "__begin").orderBy(key)
    return grouped.join(offsets, [amount, "__begin"]).withColumn(name, (F.col("__before") + F.row_number().over(inside)).cast("int")).drop("__begin", "__before")


def neighbours_of(lines: DataFrame, around: DataFrame, reach: int) -> DataFrame:
    """(file, at, line_no, line): the lines up to ``reach`` before and after each (file, line_no) of ``around``; only these are moved."""
    wanted = around.select("file", F.col("line_no").alias("at")).distinct().withColumn("line_no", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    return lines.select("file", "line_no", "line").join(wanted, ["file", "line_no"])


def joined_lines(rows: DataFrame, keys: list[str], line: Column | str, name: str) -> DataFrame:
    """(keys…, ``name``): lines in order, joined by line feeds."""
    line = F.col(line) if isinstance(line, str) else line
    pairs = F.array_sort(F.collect_list(F.struct("line_no", line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n").alias(name))
