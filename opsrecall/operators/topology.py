"""Dependency graph and call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsrecall.functions import scalars as S
from opsrecall.operators.graphs import connected_components
from opsrecall.operators.identity import with_identity


def live_dependencies(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(src_id, dst_id) whose last change is an addition."""
    changes = events.where(
        (F.col("kind") == "topology") & F.col("change").isin("dep_add", "dep_remove")
        & S.blank_to_null(F.col("from_")).isNotNull() & S.blank_to_null(F.col("to")).isNotNull()
    ).select("event_id", "us", "change", "from_", "to")
    changes = with_identity(changes, ids, "from_", "src_id")
    changes = with_identity(changes, ids, "to", "dst_id")
    last = F.max_by("change", F.struct("us", "event_id")).alias("last")
    return changes.groupBy("src_id", "dst_id").agg(last).where("last = 'dep_add'").select("src_id", "dst_id")


def neighbours(deps: DataFrame) -> DataFrame:
    """(identity_id, neighbour_id) in both directions."""
    return (
        deps.select(F.col("src_id").alias("identity_id"), F.col("dst_id").alias("neighbour_id"))
        .union(deps.select("dst_id", "src_id")).distinct()
    )


def dependency_components(deps: DataFrame) -> DataFrame:
    """(identity_id, component)."""
    comp = connected_components(deps.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    return comp.select(F.col("node").alias("identity_id"), F.col("root").alias("component"))


def name_hash(c):
    """60 bits of the md5 of a name, as a number."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def cluster_labels(members: DataFrame) -> DataFrame:
    """(identity_id, cluster) with cluster = `cluster:<least id>:<size>:<hash>`.

    The hash is an exclusive-or over the members, so that no component has to
    be gathered in one place.
    """
    per = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(name_hash(F.col("identity_id"))).alias("h"))
    label = F.concat_ws(":", F.lit("cluster"), F.col("component"), F.col("n").cast("string"), F.lower(F.hex("h")))
    return members.join(per.select("component", label.alias("cluster")), "component").select("identity_id", "cluster")


def call_sums(events: DataFrame) -> DataFrame:
    """(a, b, calls, errors, dur): calls and mentions between raw names, sums that add up over parts of a log."""
    pair = F.explode(F.arrays_zip(
        F.slice("spans", 1, F.size("spans") - 1).alias("a"), F.slice("spans", 2, F.size("spans")).alias("b"))).alias("p")
    calls = (
        events.where((F.col("kind") == "trace") & (F.size("spans") > 1))
        .select("event_id", pair)
        .select("event_id", S.blank_to_null(F.col("p.a.svc")).alias("a"),
                S.blank_to_null(F.col("p.b.svc")).alias("b"),
                F.round(F.coalesce("p.b.dur_ms", F.lit(0.0)) * 1000).cast("long").alias("dur"), F.lit(1).alias("call"))
    )
    errors = (
        events.where((F.col("kind") == "log") & (F.lower("level") == "error")
                     & S.blank_to_null(F.col("service")).isNotNull())
        .select("event_id", F.col("service").alias("a"), F.explode(S.mentions(F.col("msg"))).alias("b"),
                F.lit(None).cast("long").alias("dur"), F.lit(0).alias("call"))
    )
    return (
        calls.unionByName(errors).where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("a", "b").agg(
            F.sum("call").alias("calls"), F.sum(1 - F.col("call")).alias("errors"),
            F.sum(F.coalesce("dur", F.lit(0))).alias("dur"))
    )


def call_graph(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(source, target, call_volume, error_rate, latency) under current names."""
    return graph_of_sums(call_sums(events), ids)


def graph_of_sums(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """The call graph of ``call_sums``: renames are looked up on the few pairs of raw names."""
    named = with_identity(raw, ids, "a", "_i", "source", spread_by="b").drop("_i")
    named = with_identity(named, ids, "b", "_i", "target", spread_by="a").drop("_i")
    return (
        named.where("source <> target").groupBy("source", "target")
        .agg(F.sum("calls").alias("call_volume"), F.sum("errors").alias("errors"), F.sum("dur").alias("dur"))
        .select(
            "source", "target", "call_volume",
            F.round(F.col("errors") / F.greatest("call_volume", F.lit(1)), 4).alias("error_rate"),
            F.round(F.when(F.col("call_volume") > 0, F.col("dur") / (1000 * F.col("call_volume"))).otherwise(0.0), 1).alias("latency"),
        )
    )
