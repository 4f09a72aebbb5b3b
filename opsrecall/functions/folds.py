"""Order-dependent folds that still run in parallel.

A weight is updated by w -> clip(w * f + d, lo, hi), where f decays it over the
time since the last update. Clipping makes the updates depend on their order,
but functions of the form w -> min(hi, max(lo, a * w + b)) with a >= 0 are closed
under composition. So rows are range-partitioned by (key, time, id), and the
updates of a key that stand in one Arrow batch (a *stretch*) are composed by a
prefix scan over arrays. The few functions per key are composed in the order of
their stretches. A key holding a third of all rows is spread over many
partitions like any other.

Questions about a key at a time stand among its updates: each gets the function
of the updates before it in its stretch, to be applied to what the key had at
the beginning of the stretch. One pass answers any number of questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opsrecall.session import cut


def _decay(gap_us: np.ndarray, half_life_s: float | None) -> np.ndarray:
    return 0.5 ** (np.maximum(gap_us, 0) / 1e6 / half_life_s) if half_life_s else np.ones(len(gap_us))


def scan(first: np.ndarray, us: np.ndarray, delta: np.ndarray, lo: float, hi: float, half_life_s: float | None) -> np.ndarray:
    """Rows a, b, floor, ceiling of the composed updates from the first of a row's key up to the row.

    ``first`` is the place of the first row of the key for every row. The decay up to that
    row is left to whoever knows the time before it. Composes pairs at distance 1, 2, 4 ..
    """
    n = len(us)
    place = np.arange(n)
    gap = np.zeros(n)
    gap[1:] = us[1:] - us[:-1]
    f = np.where(place == first, 1.0, _decay(gap, half_life_s))
    a, b, fl, ce = f, delta.astype(float), np.full(n, lo), np.full(n, hi)
    step = 1
    reach = place - first
    while step <= reach.max(initial=0):
        at = np.flatnonzero(reach >= step)
        before = at - step
        held = [np.minimum(ce[at], np.maximum(fl[at], a[at] * x[before] + b[at])) for x in (fl, ce)]
        later_a, later_b = a[at] * a[before], a[at] * b[before] + b[at]
        a, b, fl, ce = a.copy(), b.copy(), fl.copy(), ce.copy()
        a[at], b[at], fl[at], ce[at] = later_a, later_b, held[0], held[1]
        step *= 2
    return np.stack([a, b, fl, ce])


_FIELDS = "key string, pos bigint, question bigint, first_us bigint, last_us bigint, n bigint, ups bigint, a double, b double, fl double, ce double"


def _stretches(batches: Iterator[pd.DataFrame], lo: float, hi: float, half_life_s: float | None) -> Iterator[pd.DataFrame]:
    """For every key of a batch its composed update (or none), and for every question that of the updates before it."""
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(batches):
        if not len(rows):
            continue
        pos = (part << 32) | number
        key, us = rows["key"].to_numpy(str), rows["us"].to_numpy(np.int64)
        asks = rows["question"].notna().to_numpy()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        segment = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(key)]))
        updates = np.flatnonzero(~asks)
        own = segment[updates]
        first = np.searchsorted(own, own, "left")
        f = scan(first, us[updates], rows["delta"].to_numpy(float)[updates], lo, hi, half_life_s)
        up = np.r_[0, np.cumsum(rows["delta"].to_numpy(float)[updates] > 0)]
        last = np.searchsorted(own, np.arange(len(new)), "right") - 1  # last update of a segment
        has = (last >= 0) & (own[np.maximum(last, 0)] == np.arange(len(new))) if len(own) else np.zeros(len(new), bool)
        done = [_rows(key[new[has]], pos, None, us[updates], first, last[has], f, up), _none(key[new[~has]], pos, None, lo, hi)]
        if asks.any():
            at = np.flatnonzero(asks)
            place = np.searchsorted(updates, at) - 1  # last update before the question
            inside = (place >= 0) & (own[np.maximum(place, 0)] == segment[at]) if len(own) else np.zeros(len(at), bool)
            question = rows["question"].to_numpy()[at].astype(np.int64)
            done.append(_rows(key[at[inside]], pos, question[inside], us[updates], first, place[inside], f, up))
            done.append(_none(key[at[~inside]], pos, question[~inside], lo, hi))
        columns = [c.split()[0] for c in _FIELDS.split(", ")]
        yield pd.concat([d[columns].astype({c: "Int64" for c in ("question", "first_us", "last_us")}) for d in done if len(d)], ignore_index=True)


def _rows(key, pos, question, us, first, place, f, up) -> pd.DataFrame:
    return pd.DataFrame({
        "key": key, "pos": pos, "question": question, "first_us": us[first[place]], "last_us": us[place],
        "n": place - first[place] + 1, "ups": up[place + 1] - up[first[place]], **dict(zip(("a", "b", "fl", "ce"), f[:, place], strict=True))})


def _none(key, pos, question, lo, hi) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "pos": pos, "question": question, "first_us": None, "last_us": None, "n": 0, "ups": 0, "a": 1.0, "b": 0.0, "fl": lo, "ce": hi})


def _laid(rows: DataFrame, partitions: int | None) -> DataFrame:
    spread = ["key", "us", "turn", "seq"]
    ranged = rows.repartitionByRange(partitions, *spread) if partitions else rows.repartitionByRange(*spread)
    return ranged.sortWithinPartitions(*spread).select("key", "us", "delta", "question")


def _updates(rows: DataFrame) -> DataFrame:
    return rows.where("key IS NOT NULL AND us IS NOT NULL").select(
        "key", "us", F.lit(1).alias("turn"), "seq", F.col("delta").cast("double").alias("delta"), F.lit(None).cast("bigint").alias("question"))


def clipped_fold(rows: DataFrame, lo: float, hi: float, half_life_s: float | None = None,
                 partitions: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(key, weight, last_us, n_stretches) from ``rows(key, us, seq, delta)``.

    Applies the rows of a key in order of (us, seq), from 0 or from the weight that
    ``start(key, weight, last_us)`` has for it. Only keys with rows are returned.
    """
    parts = _laid(_updates(rows), partitions).mapInPandas(lambda it: _stretches(it, lo, hi, half_life_s), _FIELDS)
    # One row per key and batch of rows.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "first_us", "last_us", "a", "b", "fl", "ce")))

    def join_on(acc, s):
        gap = F.greatest(F.lit(0.0), (s["first_us"] - F.coalesce(acc["t"], s["first_us"])) / 1e6)
        f = F.pow(F.lit(0.5), gap / half_life_s) if half_life_s else F.lit(1.0)
        w = F.least(s["ce"], F.greatest(s["fl"], s["a"] * acc["w"] * f + s["b"]))
        return F.struct(w.alias("w"), F.greatest(acc["t"], s["last_us"]).alias("t"))

    lists = parts.groupBy("key").agg(ordered.alias("s"))
    if start is None:
        lists = lists.withColumn("w0", F.lit(0.0)).withColumn("t0", F.lit(None).cast("bigint"))
    else:
        before = start.select("key", F.col("weight").alias("w0"), F.col("last_us").alias("t0"))
        lists = lists.join(before, "key", "left").fillna(0.0, ["w0"])
    begin = F.struct(F.col("w0").alias("w"), F.col("t0").alias("t"))
    return lists.select(
        "key", F.aggregate("s", begin, join_on).alias("f"), F.size("s").alias("n_stretches"),
    ).select("key", F.col("f.w").alias("weight"), F.col("f.t").alias("last_us"), "n_stretches")


def _states(batches: Iterator[pd.DataFrame], half_life_s: float | None) -> Iterator[pd.DataFrame]:
    """What a key had before each of its stretches, which come in order."""
    key, w, t, n, ups = None, 0.0, None, 0, 0
    for rows in batches:
        out = []
        for s in rows.itertuples(index=False):
            if s.key != key:
                key, w, t, n, ups = s.key, 0.0, None, 0, 0
            out.append((s.key, s.pos, w, t, n, ups))
            if not s.n:
                continue
            f = 0.5 ** (max(0, s.first_us - t) / 1e6 / half_life_s) if half_life_s and t is not None else 1.0
            w, t, n, ups = min(s.ce, max(s.fl, s.a * w * f + s.b)), int(s.last_us), n + s.n, ups + s.ups
        yield pd.DataFrame(out, columns=["key", "pos", "w", "t", "before", "ups_before"]).astype({"t": "Int64"})


def clipped_at(rows: DataFrame, asked: DataFrame, lo: float, hi: float, half_life_s: float | None = None,
               partitions: int | None = None) -> DataFrame:
    """(question, weight, last_us, n, ups): what ``rows(key, us, seq, delta)`` have made of a key before a time.

    ``asked(question, key, us)`` numbers its questions. Only updates with an earlier ``us``
    count; ``n`` is their number, ``ups`` that of the positive ones, ``last_us`` the time of
    the last. Without any, weight is 0 and ``last_us`` null. Every question is answered.
    """
    questions = asked.select("key", "us", F.lit(0).alias("turn"), F.col("question").alias("seq"), F.lit(0.0).alias("delta"), "question")
    made = cut(_laid(_updates(rows).unionByName(questions), partitions).mapInPandas(lambda it: _stretches(it, lo, hi, half_life_s), _FIELDS))
    stretches = made.where("question IS NULL").select("key", "pos", "first_us", "last_us", "n", "ups", "a", "b", "fl", "ce")
    # A key has a stretch for each batch of its rows; they are walked in order, keys side by side.
    states = stretches.repartition("key").sortWithinPartitions("key", "pos").mapInPandas(
        lambda it: _states(it, half_life_s), "key string, pos bigint, w double, t bigint, before bigint, ups_before bigint")
    gap = F.greatest(F.lit(0.0), (F.col("first_us") - F.col("t")) / 1e6)
    f = F.when(F.col("t").isNull(), 1.0).otherwise(F.pow(F.lit(0.5), gap / half_life_s) if half_life_s else F.lit(1.0))
    weight = F.least("ce", F.greatest("fl", F.col("a") * F.col("w") * f + F.col("b")))
    return made.where("question IS NOT NULL").join(states, ["key", "pos"]).select(
        "question", F.when(F.col("first_us").isNull(), F.col("w")).otherwise(weight).alias("weight"),
        F.coalesce("last_us", "t").alias("last_us"), (F.col("n") + F.col("before")).alias("n"), (F.col("ups") + F.col("ups_before")).alias("ups"))
