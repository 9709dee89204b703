"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of texts go to Python in batches of at most ``rows``: ten thousand texts, the default, are too much memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone (the path may be in any store)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has no such setting and runs in one process, a temporary folder is set; on a cluster, whose machines
    can't read each other's disks, that is an error.
    """
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracelens-")
        spark.conf.set(key, path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tracelens/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files under a frame from :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def wanted_rows(rows: DataFrame, ids: DataFrame, on: tuple[str, ...] = ("id",), bits: int = 24) -> DataFrame:
    """``rows`` whose ``on`` columns are among ``ids`` (distinct). A bitmap of hashed ids goes ahead of the join and keeps
    most other rows, with their texts, out of its shuffle. It has at most 2^bits / 64 words of 16 bytes, however many ids
    there are; where it fills up it only passes more rows."""
    hashed = F.xxhash64(*on)
    word = F.shiftright(F.pmod(hashed, F.lit(1 << bits)), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(hashed, F.lit(64)).cast("int"))
    words = ids.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    near = rows.withColumn("__word", word).join(F.broadcast(words), "__word").filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")
    return near.join(ids, list(on))


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): rows with a hash of their text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def fold(id_col: str, folds: int):
    """``crc32`` of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512, size: int = 8 << 20):
    """Cut record batches into smaller ones of at most ``rows`` rows and, beyond one row, about ``size`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
