"""Reports over the event log: service health, histories, lists, digests, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsrecall.functions import scalars as S
from opsrecall.functions.sets import clip
from opsrecall.operators import templates
from opsrecall.operators.identity import with_identity

# ---- fixed values ----
HISTORY = 30
HISTORY_FAMILIES = ("latency", "error_rate")
ANOMALY_MIN_EVENTS, ANOMALY_MIN_METRICS, ANOMALY_SIGMAS = 15, 3, 2.0
FACT_EDGES, FACT_MATCHES = 6, 5
WINDOW_TEXT_EVENTS = 25
SAMPLE_CAPS = {"deploy": 5, "log": 5, "metric": 5, "incident_signal": 3, "remediation": 3}
# ----------------------


def metric_rows(events: DataFrame) -> DataFrame:
    """(svc, family, us, event_id, value): metrics under raw names, one row per family whose
    name occurs in the metric's name."""
    fams = F.array_compact(F.array(*[
        F.when(F.lower(F.coalesce("name", F.lit(""))).contains(f), F.lit(f)) for f in S.METRIC_FAMILIES]))
    rows = events.where((F.col("kind") == "metric") & F.col("us").isNotNull()).select(
        "event_id", "us", F.coalesce("value", F.lit(0.0)).alias("value"), S.event_service().alias("svc"), F.explode(fams).alias("family"))
    return rows.where("svc IS NOT NULL")


def service_metrics(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(service, family, us, event_id, value): metrics under current names."""
    return with_identity(metric_rows(events), ids, "svc", "_id", "service").select("service", "family", "us", "event_id", "value")


def last_rows(metrics: DataFrame, *keys: str) -> DataFrame:
    """The row of ``latest_metrics`` for every key; the last rows of parts of a log give those of the whole."""
    last = F.max(F.struct("us", (-F.col("event_id")).alias("minus"), "value")).alias("m")
    return metrics.groupBy(*keys).agg(last).select(*keys, "m.us", (-F.col("m.minus")).alias("event_id"), "m.value")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """(service, family, value); the first event wins among equal times."""
    return metrics.groupBy("service", "family").agg(
        F.max_by("value", F.struct(F.col("us"), -F.col("event_id"))).alias("value"))


def metric_history(metrics: DataFrame, n: int = HISTORY) -> DataFrame:
    """(service, family, history): the last n values, oldest first."""
    w = Window.partitionBy("service", "family").orderBy(F.desc("us"), F.desc("value"))
    last = metrics.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy("service", "family").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_n", "value")), asc=False), lambda x: x["value"]).alias("history"))


def service_health(services: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per service with its health, status and latest metrics."""
    wide = latest.groupBy("service").pivot("family", list(S.METRIC_FAMILIES)).agg(F.first("value"))
    rows = services.join(wide, "service", "left").fillna(0.0, list(S.METRIC_FAMILIES))
    raw = 1.0 - (F.least(F.lit(1.0), F.col("error_rate")) * 0.6 + F.least(F.lit(1.0), F.col("latency") / 5000.0) * 0.4)
    health = clip(raw, 0.0, 1.0)
    return rows.select(
        "service", F.round(health, 3).alias("health"),
        F.when(health >= 0.8, "healthy").when(health >= 0.5, "degraded").otherwise("critical").alias("status"),
        F.round(F.col("latency") * 0.5, 1).alias("latency_p50"), F.round("latency", 1).alias("latency_p99"),
        F.round("error_rate", 4).alias("error_rate"), F.round("request_rate", 2).alias("request_rate"),
        F.round("cpu", 1).alias("cpu_percent"), F.round("memory", 1).alias("memory_percent"))


def action_log(events: DataFrame, ids: DataFrame, limit: int = 100) -> DataFrame:
    """Newest remediations with their target under its current name."""
    newest = events.where(F.col("kind") == "remediation").orderBy(F.desc("us"), "event_id").limit(limit).select(
        "event_id", "us", F.coalesce("incident_id", F.lit("")).alias("incident_id"), S.blank_to_null(F.col("target")).alias("target"),
        F.coalesce("action", F.lit("unknown")).alias("action"), "version", F.coalesce("outcome", F.lit("unknown")).alias("result"))
    named = with_identity(newest, ids, "target", "_id", "service").drop("_id", "target")
    return named.withColumn("service", F.coalesce("service", F.lit("unknown")))


def incident_list(sigs: DataFrame, rems: DataFrame, limit: int = 100) -> DataFrame:
    """Newest incidents known to the memory (those with a remediation)."""
    closed = sigs.join(rems.select("incident_id").distinct(), "incident_id", "left_semi")
    return closed.orderBy(F.desc("signal_us"), "incident_id").limit(limit).select(
        "incident_id", F.coalesce("affected_now", F.lit("unknown")).alias("service"), "trigger", "signal_event_id", "signal_us")


def telemetry_sample(events: DataFrame) -> DataFrame:
    """All topology events and a few of each other kind: the first ones, for
    metrics the largest."""
    caps = F.create_map(*[F.lit(x) for kv in SAMPLE_CAPS.items() for x in kv])
    w = Window.partitionBy("kind").orderBy(
        F.when(F.col("kind") == "metric", -F.coalesce("value", F.lit(0.0))).otherwise(0.0), "event_id")
    # The rank filter reaches the map side, so a kind is cut to its cap before it is shuffled.
    capped = events.where(F.col("kind").isin(*SAMPLE_CAPS)).select("event_id", "us", "kind", "value").withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= max(SAMPLE_CAPS.values())).where(F.col("_n") <= caps[F.col("kind")]).drop("_n")
    return capped.unionByName(events.where(F.col("kind") == "topology").select("event_id", "us", "kind", "value"))


def enrich_matches(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Add when and where the past incident was, and its first remediation."""
    rows = events.where("incident_id IS NOT NULL AND kind IN ('incident_signal', 'remediation')").select(
        "incident_id", "event_id", "us", "kind", F.coalesce(S.blank_to_null(F.col("service")), F.col("trigger")).alias("svc"), "action")
    is_signal, is_fix = F.col("kind") == "incident_signal", (F.col("kind") == "remediation") & F.col("action").isNotNull()
    facts = rows.groupBy("incident_id").agg(
        F.min_by("us", F.when(is_signal, F.col("event_id"))).alias("past_us"),
        F.min_by("svc", F.when(is_signal, F.col("event_id"))).alias("past_service"),
        F.min_by("action", F.when(is_fix, F.col("event_id"))).alias("past_remediation"))
    return matches.join(facts, "incident_id", "left")


def anomalous_windows(rows: DataFrame) -> DataFrame:
    """(window_id, n_events, anomalous) for ``rows(window_id, kind, level, value)``:
    at least 15 events, and a bad log, a deploy or a metric beyond two deviations."""
    metric = F.when(F.col("kind") == "metric", F.col("value"))
    bad_log = (F.col("kind") == "log") & F.lower(F.coalesce("level", F.lit(""))).isin("error", "critical", "fatal")
    # The farthest value decides, and it is the least or the greatest one.
    agg = rows.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.bool_or(bad_log | (F.col("kind") == "deploy")).alias("marked"),
        F.count(metric).alias("n_metrics"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"),
        F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    far = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) > ANOMALY_SIGMAS * F.col("sd")
    return agg.select("window_id", "n_events", (
        (F.col("n_events") >= ANOMALY_MIN_EVENTS)
        & (F.col("marked") | F.coalesce((F.col("n_metrics") >= ANOMALY_MIN_METRICS) & (F.col("sd") > 0) & far, F.lit(False)))
    ).alias("anomalous"))


def window_text(rows: DataFrame, n: int = WINDOW_TEXT_EVENTS, heads: DataFrame | None = None) -> DataFrame:
    """(window_id, text): the first n events of each window, one line each.
    ``rows(window_id, us, event_id, kind, service, fields)``; ``heads(window_id, service)``
    puts the window's service into a line of its own before them."""
    w = Window.partitionBy("window_id").orderBy("us", "event_id")
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", "us", "kind", "service", "fields")))
    t0 = F.get("r", F.lit(0))["us"]
    line = F.transform("r", lambda r: F.concat(
        F.lit("+"), F.floor((r["us"] - t0) / 1_000_000).cast("string"), F.lit("s "), r["kind"], F.lit(" of "),
        F.coalesce(r["service"], F.lit("?")), F.lit(" | "), r["fields"]))
    text = F.array_join(line, "\n")
    per = first.groupBy("window_id").agg(listed.alias("r"))
    if heads is not None:
        per = per.join(heads.select("window_id", F.col("service").alias("_head")), "window_id", "left")
        text = F.concat(F.lit("on "), F.coalesce(S.blank_to_null(F.col("_head")), F.lit("no known service")), F.lit("\n"), text)
    return per.select("window_id", text.alias("text"))


def incident_facts_text(ctx: DataFrame) -> DataFrame:
    """(incident_id, text): compact facts of a context for a writer, one `name=value` a line.

    ``ctx(incident_id, service, trigger, at, edges, matches, offers, confidence)`` with
    arrays of structs as in the context plan.
    """
    edges = F.transform(F.slice("edges", 1, FACT_EDGES), lambda e: F.concat(
        F.lit("cause="), e["cause_event_id"], F.lit(">"), e["effect_event_id"], F.lit(" p="), S.two_places(e["confidence"])))
    alike = F.transform(F.slice("matches", 1, FACT_MATCHES), lambda m: F.concat(
        F.lit("alike="), m["incident_id"], F.lit(" p="), S.two_places(m["similarity"]), F.lit(" why="), m["rationale"]))
    best = F.get("offers", F.lit(0))
    lines = F.flatten(F.array(
        F.array(F.concat_ws(" ", F.concat(F.lit("signal="), F.coalesce("trigger", F.lit("?"))), F.concat(F.lit("on="), F.coalesce("service", F.lit("?"))),
                            F.concat(F.lit("at="), F.coalesce("at", F.lit("?")))), F.concat(F.lit("certainty="), S.two_places(F.col("confidence")))),
        edges, alike,
        F.when(F.size("offers") > 0, F.array(F.concat(F.lit("fix="), best["action"], F.lit(" of="), best["target"], F.lit(" p="), S.two_places(best["confidence"]))))
        .otherwise(F.array().cast("array<string>"))))
    return ctx.select("incident_id", F.array_join(lines, "\n").alias("text"))


def totals(events: DataFrame, sigs: DataFrame, rems: DataFrame, names: DataFrame, ids: DataFrame, template_rows: DataFrame) -> DataFrame:
    """One row of totals. Every part is reduced to one row on its own."""
    from opsrecall.operators.identity import current_services, renames

    def one(df: DataFrame, *cols: Column) -> DataFrame:
        return df.agg(*cols).withColumn("_one", F.lit(1))

    closed = rems.join(sigs.select("incident_id"), "incident_id", "left_semi").select("incident_id").distinct()
    parts = [
        one(events, F.count(F.lit(1)).alias("events")),
        one(current_services(names, ids), F.count(F.lit(1)).alias("services")),
        one(sigs, F.count(F.lit(1)).alias("incidents")),
        one(closed, F.count(F.lit(1)).alias("resolved")),
        one(renames(events).select("src").distinct(), F.count(F.lit(1)).alias("renames")),
        templates.compression(template_rows).withColumn("_one", F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_one")
    return out.drop("_one")


def action_plan(ctx: DataFrame) -> DataFrame:
    """(incident_id, severity, service, confidence, cascade, actions) from
    ``ctx(incident_id, service, confidence, cascade, offers)``."""
    acts = F.transform("offers", lambda r: F.concat(r["action"], F.lit("@"), r["target"]))
    return ctx.select(
        "incident_id", S.severity(F.col("confidence")).alias("severity"), F.coalesce("service", F.lit("unknown")).alias("service"),
        "confidence", F.array_join("cascade", ",").alias("cascade"), F.array_join(acts, ",").alias("actions"))


def cascades(chains: DataFrame, events: DataFrame, rename_rows: DataFrame) -> DataFrame:
    """(incident_id, cascade): distinct services along the chain, root cause first,
    each under its name at event time."""
    from opsrecall.operators.causal import node_ids
    from opsrecall.operators.identity import resolve_at

    nodes = chains.select("incident_id", F.posexplode(node_ids(F.col("steps"))).alias("pos", "event_id"))
    named = nodes.join(events.select("event_id", "us", S.event_service().alias("name")), "event_id").where("name IS NOT NULL")
    at = resolve_at(named, rename_rows)
    return at.groupBy("incident_id").agg(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "name_at"))), lambda x: x["name_at"])).alias("cascade"))
