"""Weisfeiler-Lehman fingerprint of an incident's event graph (two rounds).

Edges are those of the causal chain, so every other window event is a lone node
whose tokens depend on its label only. Without a chain, consecutive window
events are linked instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsrecall.functions import scalars as S
from opsrecall.functions.sets import let
from opsrecall.operators.features import graph_kind
from opsrecall.operators.identity import with_identity
from opsrecall.operators.windows import interval_join


def wl_hash(level: int, text: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"wl{level}|"), text)), 1, 12)


def _next(level: int, label: Column, around: Column) -> Column:
    """Label of the next round from the own label and the neighbours' (nulls dropped)."""
    return wl_hash(level, F.concat(label, F.lit("|"), F.array_join(F.array_sort(F.array_compact(around)), ",")))


def _tag(level: int, labels: Column) -> Column:
    return F.transform(labels, lambda x: F.concat(F.lit(f"wl{level}:"), x))


def path_tokens(labels: Column) -> Column:
    """Tokens of a path graph given its node labels in order."""
    def step(level: int, prev: Column) -> Column:
        return F.transform(prev, lambda x, i: _next(level, x, F.array(F.get(prev, i - 1), F.get(prev, i + 1))))

    return let(F.transform(labels, lambda x: wl_hash(0, x)), lambda l0: let(step(1, l0), lambda l1: F.concat(
        _tag(0, l0), _tag(1, l1), _tag(2, step(2, l1)))))


def lone_tokens(labels: Column) -> Column:
    """Tokens of nodes without edges."""
    none = F.array().cast("array<string>")

    def three(label: Column) -> Column:
        return let(wl_hash(0, label), lambda l0: let(_next(1, l0, none), lambda l1: F.array(
            F.concat(F.lit("wl0:"), l0), F.concat(F.lit("wl1:"), l1), F.concat(F.lit("wl2:"), _next(2, l1, none)))))

    return F.flatten(F.transform(labels, three))


def chain_labels(steps: Column, own_id: Column) -> Column:
    """Labels along the chain, root cause first, the signal last."""
    return F.concat(
        F.transform(F.reverse(steps), lambda s: F.concat(s["label"], F.lit(":"), S.role(s["cause_id"], own_id))),
        F.array(F.concat(F.lit("incident_signal:"), S.role(own_id, own_id))))


def chain_tokens(steps: Column, labels: Column, own_id: Column) -> Column:
    """Tokens of a window whose chain is not empty. ``labels`` counts the window's
    labels; the chain's own nodes are taken off before the rest count as lone."""
    def from_chain(chain: Column) -> Column:
        lone = F.filter(labels, lambda x: x["n"] > F.size(F.filter(chain, lambda c: c == x["label"])))
        return F.array_sort(F.array_distinct(F.concat(
            path_tokens(chain), lone_tokens(F.transform(lone, lambda x: x["label"])))))

    return let(chain_labels(steps, own_id), from_chain)


def unchained_tokens(sigs: DataFrame, events: DataFrame, ids: DataFrame, before_s: int = S.WINDOW_BEFORE_S,
                     after_s: int = S.WINDOW_AFTER_S) -> DataFrame:
    """(incident_id, tokens) linking consecutive window events, for incidents
    without a chain. Neighbours come from ordered windows, nothing is gathered
    but the distinct tokens."""
    e = events.where("sec IS NOT NULL").select(
        "event_id", "us", "sec", S.event_service().alias("svc"), graph_kind().alias("label"))
    e = with_identity(e, ids, "svc", "identity_id")
    pairs = interval_join(sigs.select("incident_id", "signal_sec", "own_id"), e, "event_id", before_s, after_s)
    w = Window.partitionBy("incident_id").orderBy("us", "event_id")

    def nxt(level: int, c: str) -> Column:
        return _next(level, F.col(c), F.array(F.lag(c).over(w), F.lead(c).over(w)))

    lab = pairs.select(
        "incident_id", "us", "event_id",
        wl_hash(0, F.concat("label", F.lit(":"), S.role(F.col("identity_id"), F.col("own_id")))).alias("l0"))
    lab = lab.withColumn("l1", nxt(1, "l0")).withColumn("l2", nxt(2, "l1"))
    return (
        lab.select("incident_id", F.explode(F.array(
            *[F.concat(F.lit(f"wl{i}:"), F.col(f"l{i}")) for i in range(3)])).alias("token"))
        .groupBy("incident_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    )
