"""Nearest stored pattern of a vector, for any number of patterns.

Patterns and queries meet in blocks. A task multiplies its two blocks as matrices, adds up
again, in one order everywhere, what the product says can be the largest, and returns one
pattern for each query. The best of a query's blocks are merged as a maximum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opsrecall.operators.topk import dealt
from opsrecall.session import cut

# Shorter vectors count as without length.
NO_LENGTH = 1e-12
# More than the order of adding up changes in a product of a unit vector.
ROUNDING = 1e-9
# Numbers of a product that are held at once.
CELLS = 1 << 23


def best_patterns(patterns: np.ndarray, idx: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest cosine of every query, and the least idx that has it. Patterns have unit norm."""
    norms = np.sqrt((queries * queries).sum(axis=1))
    queries = np.where((norms < NO_LENGTH)[:, None], 0.0, queries / np.maximum(norms, NO_LENGTH)[:, None])
    order = np.argsort(idx, kind="stable")
    patterns, idx = patterns[order], idx[order]
    best, place = np.empty(len(queries)), np.empty(len(queries), np.int64)
    step = max(1, CELLS // max(1, len(patterns)))
    for a in range(0, len(queries), step):
        some = queries[a:a + step]
        rough = some @ patterns.T
        row, column = np.nonzero(rough >= rough.max(axis=1, keepdims=True) - ROUNDING)
        exact = (some[row] * patterns[column]).sum(axis=1)
        first = np.lexsort((column, -exact, row))  # the least idx of equal ones comes first
        first = first[np.r_[True, row[first][1:] != row[first][:-1]]]
        best[a:a + step], place[a:a + step] = exact[first], column[first]
    return best, idx[place]


def classify(queries: DataFrame, patterns: DataFrame, out: str = "predicted") -> DataFrame:
    """Add the `idx` of the pattern with the largest cosine to ``q`` (least idx on a tie).

    ``patterns(idx, x)`` have unit norm and as many components as every ``q``. A vector
    without length gets the least idx. Without patterns the result is null.
    """
    rows = cut(queries.withColumn("_row", F.monotonically_increasing_id()))
    known, asked = dealt(patterns.select("idx", "x", F.lit("").alias("scope")), rows.select("_row", "q", F.lit("").alias("q_scope")), ["scope"], "idx", "_row")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_row": [], "_cos": [], "_idx": []})
        cos, idx = best_patterns(np.stack(left["x"].to_numpy()).astype(float), left["idx"].to_numpy(np.int64), np.stack(right["q"].to_numpy()).astype(float))
        return pd.DataFrame({"_row": right["_row"], "_cos": cos, "_idx": idx})

    found = known.cogroup(asked).applyInPandas(search, "_row bigint, _cos double, _idx bigint")
    best = found.groupBy("_row").agg(F.max(F.struct("_cos", (-F.col("_idx")).alias("minus"))).alias("b"))
    return rows.join(best.select("_row", (-F.col("b.minus")).alias(out)), "_row", "left").drop("_row")
