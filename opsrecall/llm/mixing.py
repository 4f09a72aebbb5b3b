"""Mixing sources to target weights by nested hash histograms.

Every document has a hash. Words are summed by source and the leading bits of the hash;
the bucket in which a source's budget ends is refined by the next bits until it holds a
single hash. What lies below the threshold is taken: a filter, no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsrecall.llm.common import WORD
from opsrecall.session import cut

# Weights of the sources in code point order, repeating, and the most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
# Bits of the hash in use, and bits that one histogram resolves.
HASH_BITS = 60
STEP_BITS = 15
# Passes that fill what a document too large for the rest has left open.
FILLS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_no, source_size, target): words each source should give.

    Sources by code point, null last, share the size of all by weight. A target stops
    at ``most`` times its source's size and the excess goes to the others by weight
    until none is above: target = min(most * size, weight * level). The level comes
    from one pass over the sources by their size for a weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return per.select("source", "source_no", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_no, below, left): take the rows (source_no, hash, size) with hash < below.

    The sum of what is taken is the largest that a threshold allows within the budget
    (source_no, budget); ``left`` is what remains of it. Equal hashes go together.
    """
    state = budgets.select("source_no", F.lit(0).cast("long").alias("below"), F.lit(1 << HASH_BITS).cast("long").alias("until"), F.col("budget").alias("left"))
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        width = 1 << bits
        inside = rows.join(state, "source_no").where("hash >= below AND hash < until")
        sums = inside.groupBy("source_no", F.shiftright("hash", bits).alias("bucket")).agg(
            F.sum("size").alias("size"), (F.min("hash") != F.max("hash")).alias("several"))
        run = sums.withColumn("total", F.sum("size").over(Window.partitionBy("source_no").orderBy("bucket")))
        over = run.join(state.select("source_no", "left"), "source_no").where("total > left")
        first = over.groupBy("source_no").agg(F.min(F.struct("bucket", "size", "total", "several")).alias("b"))
        spent = inside.groupBy("source_no").agg(F.sum("size").alias("all"))
        state = cut(state.join(first, "source_no", "left").join(spent, "source_no", "left").select(
            "source_no",
            F.coalesce(F.col("b.bucket") * F.lit(width), F.col("until")).alias("below"),
            F.when(F.col("b.several"), F.col("b.bucket") * F.lit(width) + width).otherwise(F.coalesce(F.col("b.bucket") * F.lit(width), F.col("until"))).alias("until"),
            (F.col("left") - F.when(F.col("b").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("b.total") - F.col("b.size"))).alias("left")))
        if state.where("below < until").isEmpty():
            break
    return state.select("source_no", "below", "left")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, row_hash, source, size, source_size, target, taken) for every row of ``docs``.

    ``size`` is the number of words, null 0; ``taken`` is size times the copies the mix
    takes, at most ``MOST``. A source whose target is r times its size takes every
    document floor(r) times and, by hash, some once more, so reruns agree. Documents
    too large for what is left of a budget are passed over and smaller ones tried,
    ``FILLS`` times. Rows with equal id and text share their fate. Null sources are a
    source of their own; an empty table gives no rows; no other column is read.
    """
    slim = cut(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.col(text_column)), 64 - HASH_BITS).alias("hash")))
    per = cut(source_targets(slim))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("copies", F.floor(rate + 1e-12))
    per = per.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    rows = slim.join(per.select(F.col("source").alias("s"), "source_no"), F.col("source").eqNullSafe(F.col("s"))).select("source_no", "hash", "size")
    done = per.select("source_no", "budget", F.array().cast("array<struct<from:bigint,below:bigint,most:double>>").alias("taken"))
    for k in range(FILLS):
        last = F.col("taken")[F.size("taken") - 1]
        state = done.select("source_no", "budget", F.coalesce(F.when(F.size("taken") > 0, last["below"]), F.lit(0)).alias("from"))
        able = rows.join(state, "source_no").where((F.col("hash") >= F.col("from")) & ((F.col("size") <= F.col("budget")) if k else F.lit(True)))
        cuts = thresholds(able.select("source_no", "hash", "size"), done.select("source_no", "budget"))
        most = F.col("budget") if k else F.lit(float("inf"))
        done = cut(done.join(cuts, "source_no").join(state.select("source_no", "from"), "source_no").select(
            "source_no", F.col("left").alias("budget"),
            F.array_append("taken", F.struct("from", "below", most.alias("most"))).alias("taken")))
    plan = per.drop("budget").join(done, "source_no").withColumnRenamed("source", "s")
    extra = F.exists("taken", lambda t: (F.col("hash") >= t["from"]) & (F.col("hash") < t["below"]) & (F.col("size") <= t["most"]))
    return slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("hash").alias("row_hash"), "source", "size", "source_size", "target",
        (F.col("size") * F.least(F.lit(MOST), F.col("copies") + extra.cast("int"))).cast("long").alias("taken"))
