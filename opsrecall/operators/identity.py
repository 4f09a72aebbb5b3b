"""Service identity across renames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from opsrecall.functions import scalars as S
from opsrecall.operators.graphs import connected_components
from opsrecall.session import cut


def renames(events: DataFrame) -> DataFrame:
    """(src, dst, us, seq) of the usable rename events."""
    return (
        events.where((F.col("kind") == "topology") & (F.col("change") == "rename"))
        .select(S.blank_to_null(F.col("from_")).alias("src"), S.blank_to_null(F.col("to")).alias("dst"),
                F.coalesce("us", F.lit(0)).alias("us"), F.col("event_id").alias("seq"))
        .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    )


def first_hops(rename_rows: DataFrame) -> DataFrame:
    """(name, target, max_us): only the first rename of a name is followed."""
    first = F.min_by(F.struct("dst", "us"), F.col("seq")).alias("h")
    return rename_rows.groupBy(F.col("src").alias("name")).agg(first).select(
        "name", F.col("h.dst").alias("target"), F.col("h.us").alias("max_us"))


def jump_tables(hops: DataFrame) -> list[DataFrame]:
    """Tables of 1, 2, 4, ... hops at once: (name, target, max_us).

    `max_us` is the latest rename on the way, so a jump is allowed at time t
    exactly when max_us <= t. Sizes stay linear in the number of names, where
    listing every (name, later name) pair would be quadratic in chain length.
    """
    level = cut(hops)
    n = level.count()
    out: list[DataFrame] = []
    while True:
        out.append(level)
        # Names that lead into a cycle can jump for ever; `cycle_walks` owns them.
        if n == 0 or len(out) > math.ceil(math.log2(max(n, 2))) + 1:
            return out
        nxt = level.select(F.col("name").alias("target"), F.col("target").alias("t2"), F.col("max_us").alias("m2"))
        level = cut(level.join(nxt, "target").select(
            "name", F.col("t2").alias("target"), F.greatest("max_us", "m2").alias("max_us")))
        if level.isEmpty():
            return out


def cycle_walks(hops: DataFrame, jumps: list[DataFrame]) -> DataFrame | None:
    """(name, depth, target, max_us) for names that lead into a rename cycle.

    Such a walk stops on the first name seen before. None when there is no
    cycle, which is the usual case.
    """
    top = jumps[-1]
    n = jumps[0].count()
    if n == 0 or 2 ** (len(jumps) - 1) <= n:
        return None
    step = hops.select(F.col("name").alias("target"), F.col("target").alias("t2"), F.col("max_us").alias("m2"))
    live = cut(top.select("name").join(hops, "name").select(
        "name", F.lit(1).alias("depth"), "target", "max_us", F.array("name").alias("seen")))
    walks = live.drop("seen")
    while True:
        go = live.where(~F.array_contains("seen", F.col("target")))
        if go.isEmpty():
            return walks
        live = cut(go.join(step, "target").select(
            "name", (F.col("depth") + 1).alias("depth"), F.col("t2").alias("target"),
            F.greatest("max_us", "m2").alias("max_us"),
            F.array_append("seen", F.col("target")).alias("seen")))
        walks = walks.union(live.drop("seen"))


def resolve_at(rows: DataFrame, rename_rows: DataFrame, name: str = "name", us: str = "us",
               out: str = "name_at", row_id: str | None = None) -> DataFrame:
    """Add ``out``: the name that ``name`` had become at time ``us``.

    Follows first hops while their time is not later than ``us``, by binary
    lifting: log2(longest chain) lookups per row.
    """
    hops = first_hops(rename_rows)
    jumps = jump_tables(hops)
    walks = cycle_walks(jumps[0], jumps)
    usable = jumps if walks is None else [
        j.join(walks.select("name").distinct(), "name", "left_anti") for j in jumps]
    got = rows.withColumn(out, F.col(name))
    for jump in reversed(usable):
        step = jump.select(F.col("name").alias("_from"), F.col("target").alias("_to"), F.col("max_us").alias("_m"))
        got = (
            got.join(step, (F.col(out) == F.col("_from")) & (F.col("_m") <= F.col(us)), "left")
            .withColumn(out, F.coalesce("_to", out)).drop("_from", "_to", "_m")
        )
    if walks is None:
        return got
    steps = walks.groupBy(F.col("name").alias("_from")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "target", "max_us"))).alias("_w"))
    reached = F.filter("_w", lambda w: w["max_us"] <= F.col(us))
    return (
        got.join(steps, F.col(name) == F.col("_from"), "left")
        .withColumn(out, F.coalesce(F.try_element_at(reached, F.lit(-1))["target"], F.col(out)))
        .drop("_from", "_w")
    )


def identities(rename_rows: DataFrame) -> DataFrame:
    """(name, identity_id, current_name) of every name that took part in a rename.

    Names joined by renames are one identity, called by its least name; the
    current name is the target of the last rename inside the identity.
    """
    rename_rows = cut(rename_rows)
    comp = connected_components(rename_rows.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    comp = comp.select(F.col("node").alias("name"), F.col("root").alias("identity_id"))
    current = (
        rename_rows.join(comp.withColumnRenamed("name", "src"), "src")
        .groupBy("identity_id").agg(F.max_by("dst", F.struct("us", "seq")).alias("current_name"))
    )
    return cut(comp.join(current, "identity_id").select("name", "identity_id", "current_name"))


def with_identity(rows: DataFrame, ids: DataFrame, name: str, out: str, current: str | None = None,
                  spread_by: str = "event_id") -> DataFrame:
    """Add ``out`` = identity of the service in column ``name`` (itself when never renamed).

    Rows without a name get a made-up key each, so that they do not all meet in
    one partition; Spark broadcasts ``ids`` when it is measured to be small and
    splits skewed partitions otherwise.
    """
    key = F.coalesce(F.col(name), F.concat(F.lit("\u0001"), F.col(spread_by).cast("string")))
    look = ids.select(F.col("name").alias("_name"), F.col("identity_id").alias("_id"), F.col("current_name").alias("_cur"))
    got = rows.withColumn("_key", key).join(look, F.col("_key") == F.col("_name"), "left")
    got = got.withColumn(out, F.coalesce("_id", name))
    if current:
        got = got.withColumn(current, F.coalesce("_cur", name))
    return got.drop("_key", "_name", "_id", "_cur")


def aliases(ids: DataFrame) -> DataFrame:
    """(name, alias): every name of the same identity, as a lookup by identity."""
    return ids.select("identity_id", F.col("name").alias("alias"), "current_name")


def current_services(events_names: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct current names of the services seen in ``events_names(name)``."""
    seen = events_names.select("name").distinct()
    return with_identity(seen, ids, "name", "identity_id", "service", spread_by="name").select("service").distinct()
