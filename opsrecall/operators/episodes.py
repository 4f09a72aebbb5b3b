"""Episodes: everything known about an incident in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsrecall.operators import causal, features, fingerprint, topology


def remediations(events: DataFrame) -> DataFrame:
    """(incident_id, event_id, us, action, target, outcome)."""
    return events.where(
        (F.col("kind") == "remediation") & (F.coalesce("incident_id", F.lit("")) != "")
    ).select("incident_id", "event_id", "us", "action", "target", "outcome")


def closings(sigs: DataFrame, rems: DataFrame) -> DataFrame:
    """(incident_id, closed_us, last_us, actions, outcomes): incidents whose
    signal was seen before a remediation arrived."""
    after = rems.join(sigs.select("incident_id", "signal_event_id"), "incident_id").where("event_id > signal_event_id")
    return after.groupBy("incident_id").agg(F.min("us").alias("closed_us"), F.max("us").alias("last_us"))


def remediation_history(sigs: DataFrame, rems: DataFrame) -> DataFrame:
    """(incident_id, actions, outcomes, n): every signal with the distinct
    actions and outcomes recorded for it, empty when there are none."""
    none = F.array().cast("array<string>")
    per = rems.groupBy("incident_id").agg(
        F.array_sort(F.collect_set("action")).alias("actions"),
        F.array_sort(F.collect_set("outcome")).alias("outcomes"), F.count(F.lit(1)).alias("n"))
    return sigs.select("incident_id").join(per, "incident_id", "left").select(
        "incident_id", F.coalesce("actions", none).alias("actions"), F.coalesce("outcomes", none).alias("outcomes"),
        F.coalesce("n", F.lit(0)).alias("n"))


def service_context(feats: DataFrame, deps: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(incident_id, clusters, near): dependency clusters of the involved services
    and the services next to them."""
    labels = topology.cluster_labels(topology.dependency_components(deps))
    svc = feats.select("incident_id", F.explode("services").alias("identity_id"))
    alone = F.concat_ws(":", F.lit("cluster"), F.col("identity_id"), F.lit("1"),
                        F.lower(F.hex(topology.name_hash(F.col("identity_id")))))
    clusters = svc.join(labels, "identity_id", "left").groupBy("incident_id").agg(
        F.array_sort(F.collect_set(F.coalesce("cluster", alone))).alias("clusters"))
    near = svc.join(nbrs, "identity_id").groupBy("incident_id").agg(
        F.array_sort(F.collect_set("neighbour_id")).alias("near"))
    return clusters.join(near, "incident_id", "left")


def episodes(sigs: DataFrame, feats: DataFrame, chains: DataFrame, events: DataFrame, ids: DataFrame,
             deps: DataFrame, nbrs: DataFrame, rems: DataFrame) -> DataFrame:
    """One row per incident. `graph` and `pattern` hold the view of a query
    (chain cut at the plain threshold), `graph_closed` that of a closed episode
    (chain walked on to the lower one)."""
    none = F.array().cast("array<string>")
    # Size of `steps` decides which incidents need the neighbour-linked fingerprint.
    base = feats.join(chains, "incident_id", "left")
    empty_steps = F.filter("steps", lambda s: F.lit(False))
    base = base.withColumn("steps", F.coalesce("steps", F.array().cast(dict(chains.dtypes)["steps"])))
    base = base.withColumn("steps_fast", causal.fast(F.col("steps")))
    bare = base.where(F.size("steps_fast") == 0).select("incident_id", "signal_sec", "own_id")
    linked = fingerprint.unchained_tokens(bare, events, ids).withColumnRenamed("tokens", "linked")
    own = F.col("own_id")

    def graph(steps):
        return F.when(F.size(steps) > 0, fingerprint.chain_tokens(F.col(steps), F.col("labels"), own)).otherwise(
            F.coalesce("linked", none))

    around = service_context(feats, deps, nbrs)
    hist = remediation_history(sigs, rems).drop("n")
    return (
        base.join(linked, "incident_id", "left").join(around, "incident_id", "left")
        .join(hist, "incident_id").join(closings(sigs, rems), "incident_id", "left")
        .select(
            "incident_id", "signal_event_id", "signal_us", "signal_sec", "trigger", "trigger_type", "family",
            "affected_name", "own_name", "own_id", F.col("own_now").alias("service"),
            "tokens", "symptoms", "profile", "services", "latency_over",
            F.coalesce("clusters", none).alias("clusters"), F.coalesce("near", none).alias("near"),
            graph("steps_fast").alias("graph"), graph("steps").alias("graph_closed"),
            "steps", "steps_fast", causal.pattern(F.col("steps_fast")).alias("pattern"),
            causal.pattern(F.col("steps")).alias("pattern_closed"),
            "actions", "outcomes", "closed_us", "last_us")
    )


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest row per incident wins."""
    w = Window.partitionBy("incident_id").orderBy(F.desc("last_us"), F.desc("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")
