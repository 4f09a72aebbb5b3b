"""The corpus pipeline: toxic documents go, near duplicates go, personal data is masked,
sources are mixed to their weights, and what is left is packed into sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opsrecall.llm import mixing, packing, pii, queries, toxicity
from opsrecall.llm.common import table
from opsrecall.llm.ngram_join import near_duplicates
from opsrecall.session import ensure_checkpoint_dir


def _keyed(docs: DataFrame, other: DataFrame, keep: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are in ``other`` (doc_id, text_hash), under names no column of ``docs`` has."""
    other = other.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(other, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), keep)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3. Every row is judged by its own text, whatever its id."""
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"), lambda c: ~queries.held_out(c))
    return _keyed(docs, scored.where(F.col("score") >= queries.TOXIC), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id, then the least hash
    of its text, then the least in its columns; a null id comes last.

    A text without words is its own group, so all such rows stay. Columns must have an order.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    groups = near_duplicates(docs.select(row.alias("row"), "text"), "row", "text")
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.doc_id", "doc_id.text_hash", "n_shingles")
    kept = first.groupBy("doc_id", "text_hash").agg(F.sum(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("copies"))
    single = _keyed(docs, kept.where("copies < 2"), "left_semi")
    copies = _keyed(docs, kept.where("copies > 1"), "left_semi")
    one = copies.groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return single.unionByName(one.select("__row.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by its kind; ``n_chars`` follows."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to 3 times; wordless ones take no room and stay once."""
    taken = mixing.mix(docs).select(
        F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), F.col("source").alias("__source"),
        F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("__copies")).distinct()
    keyed = docs.withColumn("__row", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - mixing.HASH_BITS))
    joined = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken["__id"]) & (F.col("__row") == F.col("__hash")) & keyed["source"].eqNullSafe(taken["__source"]))
    return joined.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of every document, with its place in a sequence of 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: learned scores and the packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
