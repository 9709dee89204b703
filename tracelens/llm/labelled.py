"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(id, label, text) of at most ``per_class`` training documents of each of the ``classes``, those whose hashed ids come first.

    The choice is made on the labels table alone; at most ``per_class`` ids of a class are broadcast to the documents.
    Rows of the held-out fold, null labels and null ids never take part; of contradicting labels the larger counts, and
    of rows that repeat an id the one whose text comes first. So there are never more rows than ids.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col, folds) != held_out))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg((F.max(label) >= 1).cast("int").alias("label"))
    chosen = chosen.withColumn("rank", F.xxhash64("id"))
    parts = [chosen.filter(F.col("label") == k).orderBy("rank", "id").limit(per_class).select("id", "label") for k in classes]
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(reduce(DataFrame.unionAll, parts)), "id")
    return found.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
