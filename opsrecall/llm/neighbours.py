"""Nearest neighbours by collision counting.

Every vector is projected on many random directions, and each projection of a block of
vectors is a sorted array. Around a query's projections windows widen step by step
(virtual rehashing: wider windows hold the narrower ones); a vector that has fallen into
enough of them is verified with its true cosine. Widening ends when vectors as near as
the k-th found would have collided often enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from opsrecall.session import cut

DIRECTIONS = 64
# Share of the directions in which a vector must collide to be verified, and the width of
# the last window over the distance of the k-th found; together they set the recall.
SHARE = 0.5
REACH = 0.9
FIRST, GROWTH = 0.05, 2.5
# Vectors, and queries, of one task.
BLOCK, QUERIES = 8192, 1024
SEED = 20260101


class Collisions:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIRECTIONS))
        projected = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        # No projection of a unit vector is longer than its direction; so shifted, the arrays follow each other.
        self.most = 1.01 * np.sqrt((self.directions * self.directions).sum(axis=0)).max()
        self.shift = np.arange(DIRECTIONS) * 4 * self.most
        self.laid = (np.take_along_axis(projected, self.order.T, axis=0).T + self.shift[:, None]).ravel()

    def nearest(self, query: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest found; ties to the smaller id. ``skip`` marks rows left out."""
        n, norm = len(self.vectors), np.sqrt((query * query).sum())
        at = (query / norm) @ self.directions
        low = self._ranks(at)
        high = low.copy()
        hits = np.zeros(n, np.int64)
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        done = skip.copy()
        width = FIRST
        while True:
            a = self._ranks(at - width)
            b = np.maximum(self._ranks(at + width), high)
            rings = [o[x:y] for o, x, y in zip(self.order, a, low, strict=True)] + [o[x:y] for o, x, y in zip(self.order, high, b, strict=True)]
            hits += np.bincount(np.concatenate(rings), minlength=n)
            low, high = np.minimum(a, low), b
            fresh = np.flatnonzero((hits >= SHARE * DIRECTIONS) & ~done)
            if len(fresh):
                done[fresh] = True
                # A product in any order finds what can be among the k nearest; equal vectors then get equal cosines.
                rough = self.vectors[fresh] @ query / (self.norms[fresh] * norm)
                least = np.partition(np.concatenate([cosines, rough]), -k)[-k] if len(cosines) + len(rough) > k else -np.inf
                fresh = fresh[rough >= least - 1e-9]
                own = (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)
                rows, cosines = np.concatenate([rows, fresh]), np.concatenate([cosines, own])
                best = np.lexsort((ids[rows], -cosines))[:k]
                rows, cosines = rows[best], cosines[best]
            if done.all() or (high - low >= n).all():
                return rows, cosines
            if len(rows) == k:
                needed = REACH * np.sqrt(max(0.0, 2 - 2 * cosines[-1]))
                if width >= needed:
                    return rows, cosines
                width = min(width * GROWTH, max(needed, width * 1.01))
            else:
                width *= GROWTH

    def _ranks(self, values: np.ndarray) -> np.ndarray:
        """For every direction the number of projections below its value: one search in all arrays, laid end to end."""
        found = np.searchsorted(self.laid, np.clip(values, -self.most, self.most) + self.shift)
        return found - np.arange(DIRECTIONS) * len(self.vectors)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, size) of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where("v IS NOT NULL").where(F.coalesce(fine, F.lit(False))).withColumn("size", F.size("v"))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of every query row.

    ``is_query`` maps the id column to whether a row is a query. Candidates are all other
    rows with as many components; fewer than k are all returned. Null ids are candidates,
    not queries. Repeated rows and ids are queries and candidates each. Blocks of ``BLOCK``
    vectors meet blocks of ``QUERIES`` queries, so no task holds more than one of each
    and a group of equal vectors is spread over blocks; all rows are indexed.
    """
    rows = cut(usable(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where(is_query(F.col("vec_id")))
    n, q = (x.groupBy("size").agg(F.count(F.lit(1)).alias("n")) for x in (rows, asked))
    grid = cut(n.withColumnRenamed("n", "rows").join(q.withColumnRenamed("n", "asks"), "size").select(
        F.col("size").alias("grid_size"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("askers")))
    grid = F.broadcast(grid)  # a row for each number of components

    def celled(df: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(salt), "row"), F.col(own)).cast("int").alias(own + "_no")
        spread = df.join(grid, df["size"] == grid["grid_size"]).select("row", "vec_id", "v", "size", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other + "_no"))
        return spread.select("row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "v", "size", "blocks_no", "askers_no")

    data = celled(rows, "blocks", "askers", 1).toDF("row", "vec_id", "no_id", "v", "size", "block", "asker")
    asks = celled(asked, "askers", "blocks", 2).toDF("query_row", "query_id", "no_query_id", "query", "query_size", "query_block", "query_asker")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = Collisions(np.stack(left["v"].to_numpy()))
            ids, no_id, own = left["vec_id"].to_numpy(np.int64), left["no_id"].to_numpy(bool), left["row"].to_numpy(np.int64)
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((ids, no_id))] = np.arange(len(ids))  # ties go to the smaller id, null last
            for row, query, v in zip(right["query_row"].tolist(), right["query_id"].tolist(), right["query"], strict=True):
                rows_, cosines = index.nearest(np.asarray(v, float), own == row, place, k)
                out += [(row, query, None if no_id[i] else int(ids[i]), float(c)) for i, c in zip(rows_.tolist(), cosines, strict=True)]
        found = pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])
        return found.assign(vec_id=pd.array(found["vec_id"].tolist(), dtype="Int64"))

    cells = asks.groupBy("query_size", "query_block", "query_asker")
    found = data.groupBy("size", "block", "asker").cogroup(cells).applyInPandas(search, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
