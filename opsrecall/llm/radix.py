"""A distributed radix sort: places of rows in the order of integer keys.

Passes go from the least significant digit to the most. In each, every part counts its
digits, prefix sums over digits and parts tell where the rows of a part and digit begin,
and every part moves its rows there in the order it holds them (a stable counting sort).
The next pass deals rows by the places they have reached, so parts stay equally large
whatever key is frequent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from opsrecall.llm.common import partitions
from opsrecall.session import cut

# The widest digit, and the rows of one part.
DIGIT_BITS = 16
PART_ROWS = 1 << 17


def digits(least: int, most: int) -> list[tuple[int, int]]:
    """(shift, width) of the digits of values from ``least`` to ``most``, least significant first, of about equal width."""
    bits = (most - least).bit_length()
    n = -(-bits // DIGIT_BITS)
    width = -(-bits // n) if n else 0
    return [(k * width, width) for k in range(n)]


def stable_places(digit: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where each row of a part goes: the beginning of its digit plus the rows of that digit before it."""
    order = np.argsort(digit.astype(np.uint16), kind="stable")  # a counting sort for 16 bits
    size = np.bincount(digit, minlength=len(begin))
    inside = np.arange(len(digit)) - np.repeat(np.cumsum(size) - size, size)
    places = np.empty(len(digit), np.int64)
    places[order] = begin[digit[order]] + inside
    return places


def _pass(rows: DataFrame, digit, values: int) -> DataFrame:
    """``rows`` (part, at, ..) with the place of every row by one digit, of ``values`` possible values."""
    dealt = rows.withColumn("digit", digit.cast("int"))
    counts = dealt.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"))
    total = np.zeros(values, np.int64)
    for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():  # at most 2**DIGIT_BITS numbers
        total[r.digit] = r.n
    first = np.cumsum(total) - total
    earlier = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("part").alias("of"), F.col("digit").alias("value"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(mine: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        at = mine["at"].to_numpy(np.int64)
        begin = np.zeros(values, np.int64)
        begin[offsets["value"]] = first[offsets["value"]] + offsets["before"]
        held = np.empty(len(at), np.int64)
        held[at - at.min()] = np.arange(len(at))  # places of a part have no gaps
        places = np.empty(len(at), np.int64)
        places[held] = stable_places(mine["digit"].to_numpy(np.int64)[held], begin)
        return mine.drop(columns=["part", "at", "digit"]).assign(pos=places)

    kept = [f for f in rows.schema if f.name not in ("part", "at")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", pos long"
    return dealt.groupBy("part").cogroup(before.groupBy("of")).applyInPandas(place, schema)


def places(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, their place from 0 in ascending order of ``keys``, and how many there are.

    Keys are longs without nulls, the most significant first; no column may be null or
    named part, at, digit or pos. Rows with equal keys are next to each other in any
    order. An empty table gives an empty one. Rows must be the same when read again, as
    after ``cut``.
    """
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("low", F.min), ("high", F.max))]).first()
    n = bounds.n
    if not n:
        return rows.withColumn("pos", F.lit(0).cast("long")), 0
    chunk = -(-n // max(partitions(rows.sparkSession), -(-n // PART_ROWS)))
    first = F.monotonically_increasing_id()
    held = rows.withColumn("at", first).withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    done = None
    for i in reversed(range(len(keys))):
        low, high = bounds[f"low_{i}"], bounds[f"high_{i}"]
        # Values so far apart that their difference leaves 64 bits keep order with the sign bit turned.
        value = F.col(keys[i]) - F.lit(low) if high - low < 1 << 63 else F.col(keys[i]).bitwiseXOR(F.lit(-1 << 63))
        for shift, width in digits(low, high):
            digit = F.shiftrightunsigned(value, shift).bitwiseAND((1 << width) - 1)
            done = cut(_pass(held, digit, 1 << width))
            held = done.withColumn("part", F.floor(F.col("pos") / chunk)).withColumnRenamed("pos", "at")
    if done is None:  # all keys are equal
        done = cut(_pass(held, F.lit(0), 1))
    return done, n
