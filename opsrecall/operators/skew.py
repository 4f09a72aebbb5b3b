"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more rows than one task should take. All hot keys are
# salted; their list is joined by the plan Spark picks for its size.
ROWS_PER_TASK = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys..., splits) of every hot key: at most the rows of ``df`` over ``rows_per_task``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("splits"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner equi-join; rows of a hot key in ``big`` are spread over salts.

    ``big`` is read twice, once to count its keys, so pass a table rather than a
    long computation. ``spread_by`` is a column of ``big`` with many values. Rows of ``small``
    are repeated once per salt of their key, and only for hot keys.
    """
    hot = hot_keys(big, keys, rows_per_task)
    left = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("splits").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(spread_by), F.col("splits").cast("long")).cast("int")
        ),
    ).drop("splits")
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1))
    ).drop("splits")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
