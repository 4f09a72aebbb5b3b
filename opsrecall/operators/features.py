"""What an incident looks like: sets of tokens over the events around it.

Events are first reduced to *facts*: (second, item, identity) with the earliest
and latest microsecond inside that second and a count. Every bucket edge lies a
whole number of seconds from the signal, so one edge at most cuts a second, and
the two extremes decide exactly which buckets the second's events fall in. A
burst of any size in one second therefore costs one row per distinct item, not
one row per event. Facts and signals are not paired: a task holds those of a
stretch of time, and searches the sorted times of each distinct fact for the
buckets of its signals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.functions import scalars as S
from opsrecall.operators.identity import with_identity
from opsrecall.session import cut

# Classes of facts.
ROLE, PLAIN, SELF_ONLY, SYMPTOM, KIND, INVOLVED, LABEL, FLAG = "r", "p", "s", "y", "k", "v", "g", "f"

_FACT = "struct<cls:string,item:string>"


def _facts(*pairs: tuple[str, Column, Column | None]) -> Column:
    """Array of (class, item) structs, each kept when its condition holds."""
    made = []
    for cls, item, cond in pairs:
        fact = F.struct(F.lit(cls).alias("cls"), item.alias("item"))
        made.append(fact if cond is None else F.when(cond, fact))
    return F.array_compact(F.array(*made))


def graph_kind() -> Column:
    """Kind of a window event as a graph label sees it."""
    kind = F.col("kind")
    high = F.lower(F.coalesce("name", F.lit(""))).contains("latency") & (F.coalesce("value", F.lit(0.0)) >= S.LATENCY_HIGH_MS)
    return (
        F.when(kind == "log", F.when(F.lower("level") == "error", "log_error").otherwise("log"))
        .when(kind == "metric", F.when(high, "metric_latency_high").otherwise("metric"))
        .when(kind == "trace", F.when(F.size("spans") >= 3, "trace_fanout").otherwise("trace"))
        .otherwise(kind)
    )


def _own_facts() -> Column:
    """Facts of an event that concern its own service."""
    kind = F.col("kind")
    level = F.lower(F.coalesce("level", F.lit("")))
    name = F.lower(F.coalesce("name", F.lit("")))
    value = F.coalesce("value", F.lit(0.0))
    family = S.metric_family(F.col("name"))
    latency = name.contains("latency")
    spans = F.coalesce(F.size("spans"), F.lit(0))
    fanout = F.when(spans == 1, "1").when(spans <= 3, "2-3").otherwise("4+")
    is_ = {k: kind == k for k in ("deploy", "log", "metric", "trace", "topology", "remediation")}
    has_template = F.col("template_id").isNotNull()
    high_latency = latency & (value >= S.LATENCY_HIGH_MS)
    high_errors = ~high_latency & name.contains("error_rate") & (value >= S.ERROR_RATE_HIGH)
    return _facts(
        # behaviour tokens
        (ROLE, F.lit("deploy"), is_["deploy"]),
        (ROLE, F.lit("deploy_versioned"), is_["deploy"] & (F.coalesce("version", F.lit("")) != "")),
        (ROLE, F.concat(F.lit("log_template:"), F.col("template_id")), is_["log"] & has_template),
        (ROLE, F.concat(F.lit("log_level:"), level), is_["log"] & has_template & (level != "")),
        (ROLE, F.concat(F.lit("log:"), F.when(level == "", "any").otherwise(level)), is_["log"] & ~has_template),
        (ROLE, F.concat_ws(":", F.lit("metric"), family, S.metric_tier(F.col("name"), F.col("value"))),
         is_["metric"] & ~family.isin(*S.NOISE_FAMILIES)),
        (PLAIN, F.concat(F.lit("trace:fanout="), fanout), is_["trace"] & (spans > 0)),
        (PLAIN, F.concat(F.lit("topology:"), F.coalesce("change", F.lit("any"))), is_["topology"]),
        (ROLE, F.concat(F.lit("prior_remediation:"), F.coalesce("action", F.lit("any"))), is_["remediation"]),
        # symptoms
        (SYMPTOM, F.lit("recent_deploy"), is_["deploy"]),
        (SYMPTOM, F.when(high_latency, "latency_spike").when(high_errors, "error_rate_spike").otherwise("metric_anomaly"),
         is_["metric"]),
        (SYMPTOM, F.lit("error_log"), is_["log"] & (level == "error")),
        (SYMPTOM, F.lit("timeout"), is_["log"] & F.lower(F.coalesce("msg", F.lit(""))).contains("timeout")),
        (SYMPTOM, F.lit("trace_fanout"), is_["trace"] & (spans >= 3)),
        (SYMPTOM, F.lit("topology_change"), is_["topology"]),
        (SYMPTOM, F.lit("prior_remediation"), is_["remediation"]),
        # the rest
        (KIND, kind, kind.isNotNull()),
        (INVOLVED, F.lit(""), F.col("identity_id").isNotNull()),
        (LABEL, graph_kind(), kind.isNotNull()),
        (FLAG, F.lit("latency_over"), is_["metric"] & latency & (value > S.LATENCY_HIGH_MS)),
    )


def event_facts(events: DataFrame, ids: DataFrame, mention_re: str = S.MENTION_RE) -> DataFrame:
    """(sec, cls, item, identity_id, signal_id, min_us, max_us, n).

    ``events`` may carry `template_id`; without it log tokens fall back to the
    level. `signal_id` is set on facts of signals only, which must not count
    for their own incident.
    """
    if "template_id" not in events.columns:
        events = events.withColumn("template_id", F.lit(None).cast("string"))
    events = events.where("sec IS NOT NULL")
    base = events.select(
        "event_id", "us", "sec", "kind", S.event_service().alias("svc"), "level", "msg", "name", "value", "version",
        "spans", "change", "action", "template_id")
    base = with_identity(base, ids, "svc", "identity_id")

    # Names met inside an event: span services, and services an error log mentions.
    met = F.when(F.col("kind") == "trace", F.transform("spans", lambda s: s["svc"])).when(
        (F.col("kind") == "log") & (F.lower("level") == "error"), S.mentions(F.col("msg"), mention_re))
    inner = (
        base.select("event_id", "us", "sec", "kind", "identity_id", F.explode(F.array_distinct(met)).alias("met"))
        .where(S.blank_to_null(F.col("met")).isNotNull())
    )
    inner = with_identity(inner, ids, "met", "met_id")
    cross = (F.col("kind") == "log") & (F.col("identity_id").isNull() | (F.col("met_id") != F.col("identity_id")))
    inner = (
        inner.select(
            "us", "sec", F.lit(None).cast("bigint").alias("signal_id"), "identity_id", "met_id",
            F.explode(_facts(
                (SELF_ONLY, F.lit("trace_touches_self"), F.col("kind") == "trace"),
                (INVOLVED, F.lit(""), F.col("kind") == "trace"),
                (ROLE, F.lit("cross_service_error"), cross),
            )).alias("fact"))
        .select("us", "sec", "signal_id", F.col("fact.cls").alias("cls"), F.col("fact.item").alias("item"),
                F.when(F.col("fact.cls") == ROLE, F.col("identity_id")).otherwise(F.col("met_id")).alias("identity_id"))
    )
    own = base.select(
        "us", "sec", F.when(F.col("kind") == "incident_signal", F.col("event_id")).alias("signal_id"),
        F.explode(_own_facts()).alias("fact"), "identity_id",
    ).select("us", "sec", "signal_id", F.col("fact.cls").alias("cls"), F.col("fact.item").alias("item"),
             F.when(F.col("fact.cls").isin(ROLE, INVOLVED, LABEL), F.col("identity_id")).alias("identity_id"))
    return cut(own.unionByName(inner).groupBy("sec", "cls", "item", "identity_id", "signal_id").agg(
        F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.count(F.lit(1)).alias("n")))


# A bucket: label, offsets of its ends in seconds, whether each end belongs to it.
Edge = tuple[str, float | None, float | None, bool, bool]


def token_buckets(before: int, after: int) -> list[Edge]:
    edges: list[Edge] = [(label, -far, -near, True, near == 0) for label, far, near in S.FINE_BUCKETS[:-1]]
    label, _far, near = S.FINE_BUCKETS[-1]
    return [*edges, (label, -before, -near, True, False), ("pre", -before, 0, True, True), ("post", 0, after, False, True)]


PROFILE_BUCKETS: list[Edge] = [
    ("post", 0, 120, True, True), ("0-60s", -60, 0, True, False), ("1-5m", -300, -60, True, False),
    ("5-15m", -900, -300, True, False), ("15m+", None, -900, True, False)]
WHOLE: list[Edge] = [("", None, None, True, True)]

# Facts near a stretch of time meet its signals in one task, up to so many of each; more are split.
STRETCH_S = 4 * 3600
FACTS_PER_TASK, SIGNALS_PER_TASK = 1_000_000, 20_000


class _Signals:
    """The signals of a task in order of time, with the reach of their windows in microseconds."""

    def __init__(self, look: pa.Table, services: pa.Array, before_s: int, after_s: int):
        def code(column: str) -> np.ndarray:
            return np.where(look[column].is_null().to_numpy(), NOBODY, pc.fill_null(pc.index_in(look[column], services), UNMET).to_numpy()).astype(np.int64)

        self.us, sec = look["signal_us"].to_numpy(), look["signal_sec"].to_numpy()
        self.event_id = pc.fill_null(look["signal_event_id"], -1).to_numpy()
        self.opens, self.shuts = (sec - before_s) * 1_000_000, (sec + after_s + 1) * 1_000_000 - 1
        self.service = {c: code(c) for c in ("affected_id", "own_id")}
        self.by = {c: np.argsort(v, kind="stable") for c, v in self.service.items()}

    def of(self, column: str, service: int) -> np.ndarray:
        """The signals whose service is ``service``."""
        by = self.by[column]
        codes = self.service[column][by]
        return by[np.searchsorted(codes, service):np.searchsorted(codes, service, "right")]

    def ends(self, who: np.ndarray, edges: list[Edge]) -> tuple[np.ndarray, np.ndarray]:
        """First and last microsecond of each bucket, inside the window, for each of ``who``."""
        us, opens, shuts = self.us[who], self.opens[who], self.shuts[who]
        lo, hi = np.empty((len(who), len(edges)), np.int64), np.empty((len(who), len(edges)), np.int64)
        for i, (_, first, last, first_in, last_in) in enumerate(edges):
            lo[:, i] = opens if first is None else us + int(first * 1_000_000) + (not first_in)
            hi[:, i] = shuts if last is None else us + int(last * 1_000_000) - (not last_in)
        out = (lo > shuts[:, None]) | (hi < opens[:, None]) | (lo > hi + 1)
        lo, hi = np.maximum(lo, opens[:, None]), np.minimum(hi, shuts[:, None])
        lo[out], hi[out] = _FAR, -_FAR
        return lo, hi


# Codes of a service that is null, and of one that no fact of the task concerns.
NOBODY, UNMET = -2, -1
_FAR = 1 << 62


class _Times:
    """How many events of some facts a bucket is reached by."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray):
        by = np.argsort(first, kind="stable")
        self.first, self.to_first = first[by], np.r_[0, np.cumsum(n[by])]
        by = np.argsort(last, kind="stable")
        self.last, self.to_last = last[by], np.r_[0, np.cumsum(n[by])]

    def near(self, signals: _Signals) -> np.ndarray:
        """The signals whose windows reach from the first of the facts to the last."""
        a, b = np.searchsorted(signals.shuts, self.first[0]), np.searchsorted(signals.opens, self.last[-1], "right")
        return np.arange(a, max(a, b))

    def within(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Events of the facts that reach from ``lo`` to ``hi``: all but those that end before or begin after."""
        got = self.to_first[np.searchsorted(self.first, hi, "right")] - self.to_last[np.searchsorted(self.last, lo)]
        return np.maximum(got, 0)


def _met(facts: pa.Table, look: pa.Table, before_s: int, after_s: int) -> pa.Table:
    """(incident_id, items) of the signals of a stretch, by binary searches per distinct fact: facts
    are never paired with signals, so a task's time grows with signals times what kinds of facts there are."""
    schema = pa.schema([("incident_id", pa.string()), ("items", pa.list_(pa.struct([("item", pa.string()), ("n", pa.int64())])))])
    if not len(facts) or not len(look):
        return schema.empty_table()
    look = look.sort_by("signal_sec")
    services = pc.unique(facts["identity_id"].combine_chunks().drop_null())
    signals = _Signals(look, services, before_s, after_s)
    service = pc.fill_null(pc.index_in(facts["identity_id"], services), NOBODY).to_numpy().astype(np.int64)
    names = services.to_pylist()
    first, last, n = (facts[c].to_numpy() for c in ("min_us", "max_us", "n"))
    signal_id = pc.fill_null(facts["signal_id"], -1).to_numpy()
    kinds = pa.table([facts["cls"], facts["item"], pa.array(np.arange(len(facts)))], names=["cls", "item", "row"]).group_by(["cls", "item"]).aggregate([("row", "list")])
    tokens = token_buckets(before_s, after_s)
    labels, found = [], []  # what a signal has, and (signals, label, events)

    def add(who: np.ndarray, label: str, edges: list[Edge], counts: np.ndarray) -> None:
        for i, (bucket, *_) in enumerate(edges):
            hit = np.flatnonzero(counts[:, i] > 0)
            if len(hit):
                found.append((who[hit], np.full(len(hit), len(labels)), counts[hit, i]))
                labels.append(f"{label}:{bucket}" if bucket else label)

    def times(rows: np.ndarray) -> _Times:
        return _Times(first[rows], last[rows], n[rows])

    def by_service(rows: np.ndarray):
        """(code, rows) of each service."""
        order = rows[np.argsort(service[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(service[order])) + 1
        return [(int(service[part[0]]), part) for part in np.split(order, cuts)]

    def by_role(rows: np.ndarray, column: str, label: str, edges: list[Edge]) -> None:
        every = times(rows)
        who = every.near(signals)
        if not len(who):
            return
        lo, hi = signals.ends(who, edges)
        total, mine = every.within(lo, hi), np.zeros(lo.shape, np.int64)
        nameless, own = np.zeros(lo.shape, np.int64), signals.service[column][who]
        for code, part in by_service(rows):
            if code == NOBODY:
                nameless = times(part).within(lo, hi)
            else:
                at = np.flatnonzero(own == code) if len(who) < 64 else _inside(signals.of(column, code), who)
                if len(at):
                    mine[at] = times(part).within(lo[at], hi[at])
        unknown = np.where((own == NOBODY)[:, None], total, nameless)
        for role, counts in (("self", mine), ("peer", total - unknown - mine), ("unknown", unknown)):
            add(who, f"{label}:{role}", edges, counts)

    for cls, item, rows in zip(*(kinds[c].to_pylist() for c in ("cls", "item")), kinds["row_list"], strict=True):
        rows = rows.values.to_numpy() if item is not None else np.zeros(0, np.int64)
        if not len(rows):
            continue
        if cls == ROLE:
            by_role(rows, "affected_id", f"t|{item}", tokens)
        elif cls == LABEL:
            by_role(rows, "own_id", f"g|{item}", WHOLE)
        elif cls == SELF_ONLY:
            for code, part in by_service(rows):
                all_of = times(part)
                near = all_of.near(signals)
                who = near[_inside(signals.of("affected_id", code), near)] if code != NOBODY else near[:0]
                add(who, f"t|{item}", tokens, all_of.within(*signals.ends(who, tokens)))
        elif cls == INVOLVED:
            for code, part in by_service(rows):
                if code != NOBODY:
                    all_of = times(part)
                    who = all_of.near(signals)
                    add(who, f"v|{names[code]}", WHOLE, all_of.within(*signals.ends(who, WHOLE)))
        else:
            label, edges = {PLAIN: (f"t|{item}", tokens), SYMPTOM: (f"y|{item}", WHOLE), KIND: (f"k|{item}", PROFILE_BUCKETS), FLAG: (f"f|{item}", WHOLE)}[cls]
            all_of = times(rows)
            who = all_of.near(signals)
            lo, hi = signals.ends(who, edges)
            counts = all_of.within(lo, hi)
            if cls == KIND:
                # A signal does not count for its own incident.
                rows = rows[np.argsort(signal_id[rows], kind="stable")]
                rows = rows[signal_id[rows] >= 0]
                at, end = (np.searchsorted(signal_id[rows], signals.event_id[who], side) for side in ("left", "right"))
                for turn in range(int((end - at).max(initial=0))):
                    some = np.flatnonzero(at + turn < end)
                    own = rows[at[some] + turn]
                    counts[some] -= np.where((last[own][:, None] >= lo[some]) & (first[own][:, None] <= hi[some]), n[own][:, None], 0)
            add(who, label, edges, counts)
    if not found:
        return schema.empty_table()
    who, label, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(who, kind="stable")
    who, label, counts = who[order], label[order], counts[order]
    start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rows = pa.StructArray.from_arrays([pa.array(labels, pa.string()).take(pa.array(label)), pa.array(counts, pa.int64())], ["item", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(who)], pa.int32()), rows)
    return pa.table([look["incident_id"].take(pa.array(who[start])), lists], schema=schema)


def _inside(some: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Places in ``span``, which counts up by one, of those of ``some``, sorted, that are in it."""
    return some[(some >= span[0]) & (some <= span[-1])] - span[0] if len(span) else some[:0]


def incident_items(sigs: DataFrame, facts: DataFrame, before_s: int = S.WINDOW_BEFORE_S, after_s: int = S.WINDOW_AFTER_S,
                   facts_per_task: int = FACTS_PER_TASK, signals_per_task: int = SIGNALS_PER_TASK) -> DataFrame:
    """(incident_id, items array<struct<item, n>>): distinct items per incident, prefixed by class.

    Signals stand in the stretch of their time, facts in every stretch with a signal that they can
    be near. Stretches with many facts are split by item, and those with many signals by incident.
    """
    look = cut(sigs.where("signal_sec IS NOT NULL").select(
        "incident_id", "signal_event_id", "signal_us", "signal_sec", "affected_id", "own_id", F.floor(F.col("signal_sec") / STRETCH_S).alias("_stretch")))
    asked = look.groupBy("_stretch").agg(F.ceil(F.count(F.lit(1)) / signals_per_task).cast("int").alias("_sides"))
    reach = F.sequence(F.floor((F.col("sec") - after_s) / STRETCH_S), F.floor((F.col("sec") + before_s) / STRETCH_S))
    near = facts.withColumn("_stretch", F.explode(reach))
    stretches = cut(near.groupBy("_stretch").agg(F.ceil(F.count(F.lit(1)) / facts_per_task).cast("int").alias("_parts")).join(asked, "_stretch"))

    def part(of: str, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.col(of).cast("long")).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    on = ["_stretch", "_part", "_side"]
    left = near.join(stretches, "_stretch").withColumn("_part", part("_parts", "cls", "item")).withColumn("_side", every("_sides")).drop("_parts", "_sides")
    right = look.join(stretches, "_stretch").withColumn("_side", part("_sides", "incident_id")).withColumn("_part", every("_parts")).drop("_parts", "_sides")

    def met(near: pa.Table, look: pa.Table) -> pa.Table:
        return _met(near, look, before_s, after_s)

    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(met, "incident_id string, items array<struct<item:string,n:bigint>>")
    return found.groupBy("incident_id").agg(F.flatten(F.collect_list("items")).alias("items"))


def _of(prefix: str) -> Column:
    hits = F.filter("items", lambda x: x["item"].startswith(prefix + "|"))
    return F.array_sort(F.transform(hits, lambda x: F.substr(x["item"], F.lit(3))))


def incident_features(sigs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per incident with its item sets. The size of a set is bounded by
    the vocabulary and the number of services, not by the number of events."""
    labels = F.filter("items", lambda x: x["item"].startswith("g|"))
    symptoms = _of("y")
    return sigs.join(items, "incident_id", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<item:string,n:bigint>>"))
    ).select(
        *sigs.columns,
        S.trigger_type(F.col("trigger")).alias("trigger_type"),
        _of("t").alias("tokens"),
        F.when(F.size(symptoms) > 0, symptoms).otherwise(F.array(F.lit("unspecified"))).alias("symptoms"),
        _of("k").alias("profile"),
        _of("v").alias("services"),
        F.transform(labels, lambda x: F.struct(F.substr(x["item"], F.lit(3)).alias("label"), x["n"].alias("n"))).alias("labels"),
        F.exists("items", lambda x: x["item"] == "f|latency_over").alias("latency_over"),
    )
