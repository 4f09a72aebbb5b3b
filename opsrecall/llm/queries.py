"""The registered query of every operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsrecall.llm import chat, fingerprints, hard_negatives, mixing, neighbours, packing, pii, resampling, secrets, suffix_dedup, token_counts, toxicity
from opsrecall.llm.common import table
from opsrecall.llm.ngram_join import near_duplicates

QUERIES = {}
# A document scored this high counts as toxic.
TOXIC = 0.3


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(turns))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def held_out(doc_id: Column) -> Column:
    """Labels of every fourth id, by checksum, are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"), "nearest", "evidence")


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    def label_of(vec_id: Column, label: Column) -> Column:
        return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)

    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0, label_of)
