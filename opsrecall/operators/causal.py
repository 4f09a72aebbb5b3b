"""Causal edges and the greedy chain from a signal back to a root cause."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from opsrecall.functions import scalars as S
from opsrecall.operators.features import graph_kind
from opsrecall.operators.identity import with_identity
from opsrecall.operators.skew import hot_keys
from opsrecall.operators.windows import interval_join
from opsrecall.session import cut

# ---- fixed values: plausibility that the first kind causes the second ----
KIND_AFFINITY = {
    ("deploy", "metric"): 0.85, ("deploy", "log"): 0.70, ("deploy", "trace"): 0.55,
    ("deploy", "incident_signal"): 0.65,
    ("metric", "log"): 0.55, ("metric", "incident_signal"): 0.85, ("metric", "trace"): 0.45,
    ("log", "incident_signal"): 0.85, ("log", "log"): 0.45,
    ("trace", "log"): 0.55, ("trace", "incident_signal"): 0.50,
    ("topology", "metric"): 0.35, ("topology", "log"): 0.30, ("topology", "incident_signal"): 0.25,
}
MAX_STEPS = 5
MIN_CONFIDENCE = 0.30
DEEP_FACTOR = 0.85
HALF_LIFE_S = 7 * 24 * 3600
# What a cause scores up to so many seconds before its effect, and before that.
TEMPORAL, TEMPORAL_REST = ((1, 0.85), (60, 1.0), (180, 0.75), (600, 0.45)), 0.15
SAME_SERVICE, NEXT_SERVICE = 0.25, 0.15
TEMPORAL_SHARE, TOPOLOGY_SHARE = 0.25, 0.15
# ---------------------------------------------------------------------------

CAUSE_KINDS = tuple(sorted({c for c, _ in KIND_AFFINITY}))


def affinity(cause_kind: Column, effect_kind: Column) -> Column:
    out = None
    for (c, e), w in KIND_AFFINITY.items():
        cond = (cause_kind == c) & (effect_kind == e)
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out.otherwise(0.0)


def temporal_score(dt: Column) -> Column:
    out = F.when(dt < 0, 0.0)
    for upto, score in TEMPORAL:
        out = out.when(dt <= upto, score)
    return out.otherwise(TEMPORAL_REST)


def cause_evidence(kind: Column, level: Column, name: Column, value: Column) -> Column:
    """The cause's share of the evidence; an effect that is a signal adds 0.2."""
    n, v = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(value, F.lit(0.0))
    return (
        F.when(kind == "deploy", 0.6)
        .when(kind == "log", F.when(F.lower(level) == "error", 0.8).otherwise(0.0))
        .when(kind == "metric", F.when(n.contains("latency") & (v > 1000), 0.8)
              .when(n.contains("error_rate") & (v > 0.05), 0.7).otherwise(0.4))
        .when(kind == "topology", 0.4).otherwise(0.0)
    )


def evidence(cause_share: Column, effect_kind: Column) -> Column:
    return F.least(F.lit(1.0), cause_share + F.when(effect_kind == "incident_signal", 0.2).otherwise(0.0))


def topology_score(cause_id: Column, effect_id: Column, effect_neighbours: Column) -> Column:
    return F.coalesce(
        F.when(cause_id == effect_id, SAME_SERVICE).when(F.array_contains(effect_neighbours, cause_id), NEXT_SERVICE), F.lit(0.0))


def blend(aff: Column, temporal: Column, history: Column, topology: Column, evid: Column, relation: Column) -> Column:
    raw = (
        0.30 * aff + TEMPORAL_SHARE * temporal + 0.15 * history + TOPOLOGY_SHARE * topology + 0.10 * evid
        + 0.05 * F.greatest(F.lit(-0.5), F.least(F.lit(0.5), relation))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def reason(cause_kind: Column, effect_kind: Column, dt: Column, topology: Column, history: Column, evid: Column) -> Column:
    return F.concat_ws(
        ", ", F.concat(cause_kind, F.lit("->"), effect_kind), F.concat(F.lit("dt="), F.format_string("%.1f", dt), F.lit("s")),
        F.when(topology > 0, "topology"), F.when(history > 0, "history"), F.when(evid > 0.6, "evidence"))


def decayed(weight: Column, last_us: Column, at_us: Column) -> Column:
    dt = F.greatest(F.lit(0.0), (at_us - last_us) / 1_000_000.0)
    return F.when(last_us <= 0, weight).otherwise(weight * F.pow(F.lit(0.5), dt / HALF_LIFE_S))


def possible_causes(sigs: DataFrame, events: DataFrame, ids: DataFrame, before_s: int = S.WINDOW_BEFORE_S,
                    after_s: int = S.WINDOW_AFTER_S) -> DataFrame:
    """(event_id, us, sec, kind, share, cause_id, label): all events that can cause something and
    stand near a signal, one row each however many signals are near."""
    width = before_s + after_s
    near = sigs.where("signal_sec IS NOT NULL").select(F.explode(F.sequence(
        F.floor((F.col("signal_sec") - before_s) / width), F.floor((F.col("signal_sec") + after_s) / width))).alias("_bin")).distinct()
    e = events.where(F.col("kind").isin(*CAUSE_KINDS) & F.col("sec").isNotNull())
    e = e.withColumn("_bin", F.floor(F.col("sec") / width)).join(near, "_bin", "left_semi").select(
        "event_id", "us", "sec", "kind", S.event_service().alias("svc"),
        cause_evidence(F.col("kind"), F.col("level"), F.col("name"), F.col("value")).alias("share"),
        graph_kind().alias("label"))
    return with_identity(e, ids, "svc", "cause_id").drop("svc")


def candidate_causes(sigs: DataFrame, events: DataFrame, ids: DataFrame, before_s: int = S.WINDOW_BEFORE_S,
                     after_s: int = S.WINDOW_AFTER_S) -> DataFrame:
    """The ``possible_causes`` that a walk can choose.

    Events alike in time, kind, evidence and service score alike against any
    effect, and the earliest id wins a tie, so only that one is kept.
    """
    return possible_causes(sigs, events, ids, before_s, after_s).groupBy("us", "sec", "kind", "share", "cause_id").agg(
        F.min("event_id").alias("event_id"), F.min_by("label", "event_id").alias("label"))


def first_edges(sigs: DataFrame, causes: DataFrame, nbrs: DataFrame, before_s: int = S.WINDOW_BEFORE_S) -> DataFrame:
    """Every signal with every one of ``causes`` in its window, scored without history.

    What is known of a signal goes into the interval join with it, so that pairs, which grow
    with signals times events near them, are made and scored in place and never shuffled.
    """
    hist = history_by_effect(None, sigs.sparkSession)
    look = sigs.select(
        "incident_id", "signal_sec", F.col("signal_event_id").alias("effect_event_id"), F.col("signal_us").alias("effect_us"),
        F.lit("incident_signal").alias("effect_kind"), F.col("own_id").alias("effect_id"))
    look = look.join(adjacency(nbrs).withColumnRenamed("identity_id", "effect_id"), "effect_id", "left").join(
        F.broadcast(hist), "effect_kind", "left")
    pairs = interval_join(look, causes, "event_id", before_s).where("us < effect_us")
    return scored_edges(pairs.withColumn("topology", topology_score(F.col("cause_id"), F.col("effect_id"), F.col("nbrs"))))


def adjacency(neighbour_rows: DataFrame) -> DataFrame:
    """(identity_id, nbrs): the distinct services next to a service."""
    return neighbour_rows.groupBy("identity_id").agg(F.array_sort(F.collect_set("neighbour_id")).alias("nbrs"))


def history_by_effect(edge_stats: DataFrame | None, spark) -> DataFrame:
    """(effect_kind, hist): per effect kind a map cause kind -> (rate, weight,
    last_us). At most one row per kind in the affinity table, or per incident and kind
    if ``edge_stats`` has an incident_id."""
    if edge_stats is None:
        return spark.createDataFrame(
            [], "effect_kind string, hist map<string,struct<rate:double,weight:double,last_us:bigint>>")
    by = ["incident_id", "effect_kind"] if "incident_id" in edge_stats.columns else ["effect_kind"]
    known = edge_stats.where(F.concat_ws(">", "cause_kind", "effect_kind").isin([f"{c}>{e}" for c, e in KIND_AFFINITY]))
    return known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
        "cause_kind", F.struct(F.col("success_rate").alias("rate"), F.col("weight"), F.col("last_us"))))).alias("hist"))


def scored_edges(pairs: DataFrame) -> DataFrame:
    """Add dt, history, evidence and score to cause/effect pairs.

    Needs cause columns (event_id, us, kind, share, cause_id), effect columns
    (effect_event_id, effect_us, effect_kind, effect_id, hist) and `topology`.
    """
    h = F.col("hist")[F.col("kind")]
    return (
        pairs.withColumn("dt", (F.col("effect_us") - F.col("us")) / 1_000_000.0)
        .withColumn("aff", affinity(F.col("kind"), F.col("effect_kind"))).where("aff > 0")
        .withColumn("history", F.coalesce(h["rate"], F.lit(0.0)))
        .withColumn("relation", F.coalesce(decayed(h["weight"], h["last_us"], F.col("effect_us")), F.lit(0.0)))
        .withColumn("evid", evidence(F.col("share"), F.col("effect_kind")))
        .withColumn("score", blend(F.col("aff"), temporal_score(F.col("dt")), F.col("history"), F.col("topology"),
                                   F.col("evid"), F.col("relation")))
    )


# Causes of one stretch of time meet its effects in one task, up to so many of each; more are split.
BIN_US = 8 * 3600 * 1_000_000
CAUSES_PER_TASK, EFFECTS_PER_TASK = 500_000, 50_000
_TIME_BITS = 35  # a microsecond within a bin
_COPIED = ["incident_id", "effect_event_id", "effect_us", "effect_kind", "effect_id", "hist"]
_CAUSE = ["event_id", "us", "kind", "share", "cause_id", "label"]


def _spans(effect_us: np.ndarray, lo_us: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(from, before, temporal score) of every effect: where causes have that score."""
    made, end = [], effect_us
    for upto, score in TEMPORAL:
        start = np.maximum(effect_us - upto * 1_000_000, lo_us)
        made.append((start, end, score))
        end = start
    return [*made, (lo_us, end, TEMPORAL_REST)]


def _leading(causes: pa.Table, look: pa.Table) -> pa.Table:
    """Pairs of every effect with the causes that can be its best.

    Causes of one kind and share differ in their score for an effect by time and service alone.
    So of those in one span of time, on the effect's service, next to it or anywhere, only the
    earliest can win, and it is found by binary search; of what is found per kind and share,
    all within rounding of the best are returned.
    """
    empty = look.slice(0, 0).select(_COPIED), causes.slice(0, 0).select(_CAUSE)
    chosen_effects, chosen_causes, chosen_topology = [], [], []
    if len(causes) and len(look):
        base = (look["_bin"][0].as_py()) * BIN_US
        us, event_id = (causes[c].to_numpy() for c in ("us", "event_id"))
        names = pc.unique(causes["cause_id"].combine_chunks().drop_null())
        service = pc.fill_null(pc.index_in(causes["cause_id"], names), -1).to_numpy().astype(np.int64)
        effect_service = pc.fill_null(pc.index_in(look["effect_id"], names), -1).to_numpy().astype(np.int64)
        lo, hi = look["lo_us"].to_numpy(), look["effect_us"].to_numpy()
        spans = _spans(hi, lo)
        n = len(look)
        nbrs = look["nbrs"].combine_chunks()
        owner = pc.list_parent_indices(nbrs).to_numpy().astype(np.int64)
        nbr = pc.fill_null(pc.index_in(pc.list_flatten(nbrs), names), -1).to_numpy().astype(np.int64)
        owner, nbr = owner[nbr >= 0], nbr[nbr >= 0]
        everyone, own = np.arange(n), np.flatnonzero(effect_service >= 0)
        kinds, effect_kind = causes["kind"].to_numpy(), look["effect_kind"].to_numpy()
        shares = causes["share"].to_numpy()
        limit = (1 << _TIME_BITS) - 1

        def at(t):
            return np.clip(t - base, 0, limit)

        for kind in np.unique(kinds.astype(str)):
            caused = np.isin(effect_kind.astype(str), [e for c, e in KIND_AFFINITY if c == kind])
            for share in np.unique(shares[kinds == kind]) if caused.any() else ():
                rows = np.flatnonzero((kinds == kind) & (shares == share))
                laid = {}
                for name, code in (("any", np.zeros(len(rows), np.int64)), ("service", service[rows])):
                    keys = (code << _TIME_BITS) | at(us[rows])
                    order = np.lexsort((event_id[rows], keys))
                    order = order[code[order] >= 0]
                    laid[name] = keys[order], rows[order]
                found = []  # (effect, cause, topology, value)
                for who, code, table, topology in (
                        (everyone, np.zeros(n, np.int64), "any", 0.0), (own, effect_service[own], "service", SAME_SERVICE),
                        (owner, nbr, "service", NEXT_SERVICE)):
                    some = caused[who]
                    who, code = who[some], code[some]
                    keys, where = laid[table]
                    if not len(who) or not len(keys):
                        continue
                    for start, end, score in spans:
                        place = np.searchsorted(keys, (code << _TIME_BITS) | at(start[who]))
                        inside = place < len(keys)
                        inside &= keys[np.minimum(place, len(keys) - 1)] < ((code << _TIME_BITS) | at(end[who]))
                        cause = where[place[inside]]
                        found.append((who[inside], cause, np.full(len(cause), topology),
                                      np.full(len(cause), TEMPORAL_SHARE * score + TOPOLOGY_SHARE * topology)))
                if not found:
                    continue
                effect, cause, topology, value = (np.concatenate(x) for x in zip(*found, strict=True))
                best = np.full(n, -np.inf)
                np.maximum.at(best, effect, value)
                keep = value >= best[effect] - 1e-9
                # Of neighbours that tie the earliest wins.
                effect, cause, topology, value = effect[keep], cause[keep], topology[keep], value[keep]
                order = np.lexsort((event_id[cause], us[cause], topology, value, effect))
                effect, cause, topology, value = effect[order], cause[order], topology[order], value[order]
                first = np.r_[True, (effect[1:] != effect[:-1]) | (value[1:] != value[:-1]) | (topology[1:] != topology[:-1])] if len(effect) else []
                chosen_effects.append(effect[first])
                chosen_causes.append(cause[first])
                chosen_topology.append(topology[first])
    if not chosen_effects:
        effects, found_causes, topology = *empty, np.zeros(0)
    else:
        effects = look.select(_COPIED).take(np.concatenate(chosen_effects))
        found_causes = causes.select(_CAUSE).take(np.concatenate(chosen_causes))
        topology = np.concatenate(chosen_topology)
    return pa.table([*effects.columns, *found_causes.columns, pa.array(topology, pa.float64())], names=[*_COPIED, *_CAUSE, "topology"])


def leading_causes(look: DataFrame, pool: DataFrame, causes_per_task: int = CAUSES_PER_TASK,
                   effects_per_task: int = EFFECTS_PER_TASK) -> DataFrame:
    """Effects with the causes among which their best is: a few rows per effect, however dense the events.

    ``pool`` are causes with their `_bin`; ``look`` needs `lo_us`, before which a cause is too
    early. Stretches with many causes or effects are dealt to a grid of tasks; the best of the
    parts is the best of all.
    """
    bins = F.sequence(F.floor(F.col("lo_us") / BIN_US), F.floor((F.col("effect_us") - 1) / BIN_US))
    effects = cut(look.where("lo_us < effect_us").withColumn("_bin", F.explode(bins)))
    of_causes = hot_keys(pool, ["_bin"], causes_per_task).withColumnRenamed("splits", "_parts")
    of_effects = hot_keys(effects, ["_bin"], effects_per_task).withColumnRenamed("splits", "_sides")

    def dealt(df, key):
        """Rows go to one part of their own and to all of the others'."""
        mine, theirs = ("_parts", "_sides") if key == "event_id" else ("_sides", "_parts")
        df = df.join(of_causes, "_bin", "left").join(of_effects, "_bin", "left").fillna(1, ["_parts", "_sides"])
        return df.withColumn(mine, F.pmod(F.xxhash64(key), F.col(mine).cast("long")).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))

    on = ["_bin", "_parts", "_sides"]
    schema = T.StructType([*(effects.schema[c] for c in _COPIED), *(pool.schema[c] for c in _CAUSE), T.StructField("topology", T.DoubleType())])
    return dealt(pool, "event_id").groupBy(*on).cogroup(dealt(effects, "incident_id").groupBy(*on)).applyInArrow(_leading, schema)


_BEST = ["event_id", "us", "kind", "cause_id", "label", "dt", "topology", "history", "evid", "score",
         "effect_event_id", "effect_us", "effect_kind", "effect_id"]


def chains(sigs: DataFrame, causes: DataFrame, nbrs: DataFrame, edge_stats: DataFrame | None = None,
           max_steps: int = MAX_STEPS, min_confidence: float = MIN_CONFIDENCE * DEEP_FACTOR,
           before_s: int = S.WINDOW_BEFORE_S) -> DataFrame:
    """(incident_id, steps): the chain read backwards, signal's cause first.

    Each step looks for the best cause of every incident's current effect among the causes in
    the signal's window; causes only get earlier, so none is used twice. Incidents and causes
    are never paired (see ``leading_causes``): a step moves the causes, one row per incident
    and a few leading causes of each. Stopping at a higher threshold later (see ``fast``) gives
    the same chain cut short, since the walk itself does not depend on the threshold.
    ``edge_stats`` with an incident_id hold what was known at each signal.
    """
    spark = sigs.sparkSession
    hist = history_by_effect(edge_stats, spark)
    at_signal = "incident_id" in hist.columns
    hist = cut(hist) if at_signal else F.broadcast(hist)
    adj = cut(adjacency(nbrs))
    pool = cut(causes.select(*_CAUSE, F.floor(F.col("us") / BIN_US).alias("_bin")))

    frontier = sigs.where("signal_us IS NOT NULL").select(
        "incident_id", ((F.col("signal_sec") - before_s) * 1_000_000).alias("lo_us"), F.col("signal_event_id").alias("effect_event_id"),
        F.col("signal_us").alias("effect_us"), F.lit("incident_signal").alias("effect_kind"), F.col("own_id").alias("effect_id"))
    start = frontier.select("incident_id", "lo_us")
    steps = None
    for i in range(max_steps):
        look = (
            frontier.join(adj.withColumnRenamed("identity_id", "effect_id"), "effect_id", "left")
            .join(hist, ["incident_id", "effect_kind"] if at_signal else "effect_kind", "left")
        )
        scored = scored_edges(leading_causes(look, pool)).where(F.col("score") >= min_confidence)
        best = scored.groupBy("incident_id").agg(F.max_by(
            F.struct(*_BEST), F.struct(F.col("score"), -F.col("us"), -F.col("event_id"))).alias("b"))
        best = cut(best.select("incident_id", F.lit(i).alias("step"), "b.*"))
        steps = best if steps is None else steps.unionByName(best)
        frontier = best.select(
            "incident_id", F.col("event_id").alias("effect_event_id"), F.col("us").alias("effect_us"),
            F.col("kind").alias("effect_kind"), F.col("cause_id").alias("effect_id")).join(start, "incident_id")
    edge = F.struct("step", *_BEST)
    return steps.groupBy("incident_id").agg(F.array_sort(F.collect_list(edge)).alias("steps"))


def fast(steps: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """The chain as it is when the walk stops at the first weaker edge."""
    weak = F.filter(F.transform(steps, lambda s: F.when(s["score"] < min_confidence, s["step"])), lambda x: x.isNotNull())
    first_weak = F.array_min(weak)
    return F.filter(steps, lambda s: first_weak.isNull() | (s["step"] < first_weak))


def forward(steps: Column) -> Column:
    """Output edges, root cause first."""
    return F.transform(F.reverse(steps), lambda s: F.struct(
        s["event_id"].cast("string").alias("cause_event_id"),
        s["effect_event_id"].cast("string").alias("effect_event_id"),
        reason(s["kind"], s["effect_kind"], s["dt"], s["topology"], s["history"], s["evid"]).alias("evidence"),
        F.round(s["score"], 4).alias("confidence"),
        F.timestamp_micros(s["us"]).alias("cause_ts"),
        F.timestamp_micros(s["effect_us"]).alias("effect_ts"),
    ))


def pattern(steps: Column) -> Column:
    """`cause->effect` kinds, root cause first."""
    return F.transform(F.reverse(steps), lambda s: F.concat(s["kind"], F.lit("->"), s["effect_kind"]))


def node_ids(steps: Column) -> Column:
    """Event ids on the chain, root cause first, signal last."""
    return F.when(F.size(steps) > 0, F.concat(
        F.transform(F.reverse(steps), lambda s: s["event_id"]),
        F.array(F.element_at(steps, 1)["effect_event_id"]))).otherwise(F.array().cast("array<bigint>"))
