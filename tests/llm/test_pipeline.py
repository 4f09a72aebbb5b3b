"""Stages of the pipeline on tables with null and repeated ids."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from opsrecall.llm import mixing, toxicity
from tests.llm.test_operators import sentence

SCHEMA = "doc_id long, text string, source string"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_toxic_row_takes_no_other_with_its_id(spark, monkeypatch):
    rows = [(None, "clean one", "a"), (None, "vile", "a"), (None, None, "a"), (1, "clean two", "a"), (1, "vile", "b"), (2, "vile", "a"), (2, "vile", "b"), (3, "", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def scores(docs, *_):
        return docs.select("doc_id", F.when(F.col("text") == "vile", 0.9).otherwise(0.1).alias("score"), F.lit(0.0).alias("nearest"), F.xxhash64("text").alias("text_hash"))

    monkeypatch.setattr(toxicity, "scores", scores)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    assert collected(corpus_pipeline.drop_toxic(spark, docs, "")) == sorted((r for r in rows if r[1] != "vile"), key=str)


def test_scores_name_the_text_they_belong_to(spark):
    docs = spark.createDataFrame([(i % 3 or None, f"word{i % 7} again" if i % 5 else None, "a") for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels, lambda c: F.lit(True)).select("doc_id", "text_hash")
    assert collected(got) == collected(docs.select("doc_id", F.xxhash64("text")))


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 60).strip() for _ in range(4))
    rows = [
        (None, a + " more", "x"), (5, a, "y"), (5, a, "x"), (4, a + " other", "x"),  # 4 stays
        (None, b, "x"), (None, b, "x"), (None, b + " more", "y"),  # one without an id stays
        (5, c, "z"), (5, c, "y"), (5, c, "y"),  # the same id as above, another group: one stays
        (None, d, "x"),
        (None, "", "x"), (6, " ", "x"), (6, " ", "x"), (7, None, "x")]  # wordless ones are no duplicates
    got = collected(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), ""))
    with_words = [r for r in got if (r[1] or "").strip()]
    assert len(with_words) == 4
    assert {(4, a + " other", "x"), (5, c, "y"), (None, d, "x")} <= set(with_words)
    assert [r for r in got if not (r[1] or "").strip()] == sorted(rows[-4:], key=str)


def test_equal_rows_of_two_sources_are_mixed_by_source(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "b"), (2, "four five six", "a"), (3, "seven", None), (4, None, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [tuple(r)[:1] + (r.source,) for r in mixing.mix(docs).collect() for _ in range(1 if not r.size else r.taken // r.size)]
    got = [(r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
