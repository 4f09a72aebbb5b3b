"""Hard negatives by the threshold algorithm over sorted dimensions.

The components of a block of vectors are sorted once in every dimension. An anchor reads
each list from the end its sign favours, scores every row it meets by its integer inner
product, and stops once no unread row can reach the last place it still has to fill.

An anchor's positives are searched first, among rows of its label. Each positive then opens
a window of scores, and all windows of an anchor are filled in one reading of the rows of
other labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from opsrecall.session import cut

K = 5
# A negative scores from LOW to HIGH hundredths of its positive.
LOW, HIGH = 80, 100
# Vectors, and anchors, of one task.
BLOCK, ANCHORS = 8192, 1024
# Rows that an anchor first reads of every list; each step then reads twice as many.
FIRST = 16


class SortedLists:
    """Rows of a block, in every dimension in the order of their components."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.doubles = vectors, vectors.astype(np.float64)
        self.size = np.abs(self.doubles).max(initial=0.0)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()

    def read(self, anchor: np.ndarray, done: Callable[[np.ndarray, np.ndarray, int | None], bool]) -> None:
        """Reads deeper until ``done(rows, scores, threshold)``; no row that is not in ``rows``
        so far has a score above ``threshold``, which is None once all rows are read."""
        n, dims = len(self.vectors), np.flatnonzero(anchor)
        # Whole numbers are exact in double precision as long as every sum stays below 2**53.
        exact = self.size * np.abs(anchor.astype(np.float64)).max(initial=0.0) * max(1, len(anchor)) < 2.0 ** 53
        vectors, own = (self.doubles, anchor.astype(np.float64)) if exact else (self.vectors, anchor)
        up = anchor[dims] > 0
        seen = np.zeros(n, bool)
        at, depth = 0, FIRST
        while True:
            depth = min(depth, n)
            if not len(dims) or depth == n:
                fresh = np.flatnonzero(~seen)
                threshold = None
            else:
                met = np.concatenate([self.order[dims[up], n - depth:n - at].ravel(), self.order[dims[~up], at:depth].ravel()])
                new = np.zeros(n, bool)
                new[met] = True
                fresh = np.flatnonzero(new & ~seen)
                last = np.where(up, self.sorted[dims, n - depth], self.sorted[dims, depth - 1])
                threshold = int((anchor[dims].astype(object) * last.astype(object)).sum())
            seen[fresh] = True
            if done(fresh, (vectors[fresh] @ own).astype(np.int64), threshold) or threshold is None:
                return
            at, depth = depth, depth * 2


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


class Best:
    """The k highest of the rows fed so far whose scores lie in a window, ties by smaller id."""

    def __init__(self, ids: np.ndarray, k: int, low: int | None = None, high: int | None = None):
        self.all, self.k, self.low, self.high = ids, k, low, high
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.low is not None:
            fits = (scores >= self.low) & (scores <= self.high)
            rows, scores = rows[fits], scores[fits]
        if len(rows):
            rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
            keep = _first(self.all[rows], scores, self.k)
            self.rows, self.scores = rows[keep], scores[keep]

    def closed(self, threshold: int | None) -> bool:
        """Whether no row with a score of at most ``threshold`` can come in any more; equal scores can."""
        if threshold is None or self.low is not None and (threshold < self.low or self.high < self.low):
            return True
        return len(self.rows) == self.k and threshold < int(self.scores[-1])


def _places(rows: pd.DataFrame) -> np.ndarray:
    """Places of the rows by id, null last."""
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((rows["vec_id"].to_numpy(np.int64), rows["no_id"].to_numpy(bool)))] = np.arange(len(rows))
    return place


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative: LOW * positive <= 100 * score <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def rows_of(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, label_of: Callable[[Column, Column], Column] | None) -> DataFrame:
    """(row, vec_id, no_id, label, v, size) of the rows that take part, components as floor(256 * x); a null id is 0 here."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"),
        F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    if label_of is not None:
        rows = rows.withColumn("label", label_of(F.col("vec_id"), F.col("label")))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "label",
        F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"), F.size("v").alias("size"))


def _cells(data: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[GroupedData, GroupedData]:
    """Both sides by key and block numbers, the asked columns under names of their own, so that every block of ``data`` meets every block of ``asked`` with its keys."""
    n = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    q = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("asks"))
    grid = cut(n.join(q, keys).select(*keys, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asks") / ANCHORS).cast("int").alias("askers")))

    def dealt(df: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(salt), "row"), F.col(own)).cast("int")
        return df.join(grid, keys).withColumn(f"{own}_no", mine).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("blocks", "askers")

    cell = [*keys, "blocks_no", "askers_no"]
    asks = dealt(asked, "askers", "blocks", 2)
    asks = asks.toDF(*(f"asked_{c}" for c in asks.columns))
    return dealt(data, "blocks", "askers", 1).groupBy(*cell), asks.groupBy(*(f"asked_{c}" for c in cell))


def positives(rows: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """(anchor_row, anchor_id, positive_id, positive_row, score): the k best other rows of each anchor's label."""
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            places, own = _places(left), left["row"].to_numpy(np.int64)
            ids, no_id = left["vec_id"].to_numpy(np.int64), left["no_id"].to_numpy(bool)
            lists = SortedLists(np.stack(left["v"].to_numpy()).astype(np.int64))
            for row, anchor_id, v in zip(right["asked_row"].tolist(), right["asked_vec_id"].tolist(), right["asked_v"], strict=True):
                best = Best(places, k)

                def done(fresh, scores, threshold, row=row, best=best):
                    other = own[fresh] != row
                    best.feed(fresh[other], scores[other])
                    return best.closed(threshold)

                lists.read(np.asarray(v, np.int64), done)
                out += [(row, anchor_id, int(ids[i]), bool(no_id[i]), int(own[i]), int(s)) for i, s in zip(best.rows, best.scores, strict=True)]
        return pd.DataFrame(out, columns=["anchor_row", "anchor_id", "positive_id", "no_positive_id", "positive_row", "score"])

    data, asks = _cells(rows, asked, ["size", "label"])
    found = data.cogroup(asks).applyInPandas(search, "anchor_row long, anchor_id long, positive_id long, no_positive_id boolean, positive_row long, score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    found = found.withColumn("positive_id", F.when(~F.col("no_positive_id"), F.col("positive_id")))
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n", "no_positive_id")


def negatives(rows: DataFrame, asked: DataFrame, found: DataFrame, k: int = K) -> DataFrame:
    """(anchor_row, score, negative_id, negative_score): for every score of a positive the k
    best rows of other labels in its window, in each block; the caller merges blocks."""
    windows = found.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_set("score"), asc=False).alias("windows"))
    asked = asked.join(windows, "row")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            places, labels = _places(left), left["label"].to_numpy(np.int64)
            ids, no_id = left["vec_id"].to_numpy(np.int64), left["no_id"].to_numpy(bool)
            lists = SortedLists(np.stack(left["v"].to_numpy()).astype(np.int64))
            for row, label, v, scores_ in zip(right["asked_row"].tolist(), right["asked_label"].tolist(), right["asked_v"], right["asked_windows"], strict=True):
                best = {int(p): Best(places, k, *window(int(p))) for p in scores_}

                def done(fresh, scores, threshold, label=label, best=best):
                    other = labels[fresh] != label
                    fresh, scores = fresh[other], scores[other]
                    for b in best.values():
                        b.feed(fresh, scores)
                    return all(b.closed(threshold) for b in best.values())

                lists.read(np.asarray(v, np.int64), done)
                out += [(row, p, int(ids[i]), bool(no_id[i]), int(s)) for p, b in best.items() for i, s in zip(b.rows, b.scores, strict=True)]
        return pd.DataFrame(out, columns=["anchor_row", "score", "negative_id", "no_negative_id", "negative_score"])

    data, asks = _cells(rows, asked, ["size"])
    best = data.cogroup(asks).applyInPandas(search, "anchor_row long, score long, negative_id long, no_negative_id boolean, negative_score long")
    return best.withColumn("negative_id", F.when(~F.col("no_negative_id"), F.col("negative_id"))).drop("no_negative_id")


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], label_of: Callable[[Column, Column], Column] | None = None, k: int = K,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(256 * x); scores are whole inner products and must fit 64
    bits. ``is_anchor`` maps the id column to whether a row is an anchor, ``label_of`` an
    id and a label to the label that counts. Rows with a null label or vector, or a null
    or non-finite component, take no part; rows with a null id are no anchors; only
    vectors with as many components meet. Higher scores come first, ties by smaller id. Repeated rows and ids are rows of their
    own: each is an anchor, a positive and a negative. Anchors without a positive, and
    positives with an empty window, give no rows; so does an empty table. Other columns
    are not read.

    Blocks of ``BLOCK`` rows meet blocks of ``ANCHORS`` anchors, so a task holds one of
    each at most, whatever label or vector is frequent.
    """
    rows = cut(rows_of(vectors, id_column, vector_column, label_column, label_of))
    asked = rows.where(~F.col("no_id") & is_anchor(F.col("vec_id")))
    found = cut(positives(rows, asked, k))
    # One list for each window: positives with equal scores share it.
    order = Window.partitionBy("anchor_row", "score").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    best = negatives(rows, asked, found, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(best, ["anchor_row", "score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
