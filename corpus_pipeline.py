"""The corpus pipeline: toxic documents go, near-duplicates and repeated passages go, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import minhash, packing, pii, suffix_dedup, toxicity
from tracelens.llm.common import materialize, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; the model learns from labelled rows outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates (five words, similarity of 0.8 or more). Rows
    without an id stay, and so do rows that repeat a kept id with another text; of rows equal in id and text one stays."""
    kept = minhash.near_duplicates(docs, k=5, percent=80).filter("kept and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    key, hash_col = unused(docs, "id"), unused(docs, "hash")
    kept = materialize(kept.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_col), "rows"))
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_col))
    known = docs.join(kept.drop("rows"), same, "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        known = known.dropDuplicates(["doc_id", "text"])
    return known.select(*docs.columns).unionAll(docs.filter("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one holds; their first places keep them."""
    out = suffix_dedup.without(docs, suffix_dedup.repeated_passages(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a placeholder for each piece of personal data."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Compression distances, sketches and least squares have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
