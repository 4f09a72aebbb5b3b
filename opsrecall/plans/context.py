"""The context of every signal: matches, causal chain, related events,
remediations, confidence and a short narrative, for all signals in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsrecall.functions import scalars as S
from opsrecall.functions.sets import clip
from opsrecall.operators import (
    causal, episodes as E, features, identity, learning, remediation, similarity, templates, topology, windows,
)
from opsrecall.session import cut

# ---- fixed values ----
RELATED_CAP = {"fast": 30, "deep": 60}
DECOY_FLOOR, DECOY_SIMILARITY, DECOY_CONFIDENCE = 0.55, 0.45, 0.4
# ----------------------


@dataclass
class Memory:
    """Tables derived from an event log, shared by the queries on it."""

    events: DataFrame
    ids: DataFrame
    sigs: DataFrame
    deps: DataFrame
    nbrs: DataFrame
    rems: DataFrame
    chains: DataFrame
    episodes: DataFrame
    graded: DataFrame
    edge_outcomes: DataFrame
    #: Whether what a signal is told stops at its time.
    as_of: bool = True


def templated(events: DataFrame, clustered: bool = False) -> DataFrame:
    """Give log events a `template_id`: their masked shape, or the template their
    shape was clustered into."""
    logs = events.where(F.col("kind") == "log")
    if clustered:
        table = templates.cluster(templates.shapes(logs.select("us", "msg")))
        return (
            events.withColumn("_shape", F.when(F.col("kind") == "log", templates.shape_of(F.col("msg"))))
            .join(table.select(F.col("shape").alias("_shape"), "pattern"), "_shape", "left")
            .withColumn("template_id", templates.template_id(F.col("pattern"))).drop("_shape", "pattern")
        )
    return events.withColumn("template_id", F.when(
        F.col("kind") == "log", templates.template_id(templates.shape_of(F.col("msg")))))


def learned_edges(outcomes: DataFrame, sigs: DataFrame, as_of: bool) -> DataFrame:
    """Success rates and weights of edges for the second walk: as of each signal, or of the whole log."""
    if as_of:
        return learning.edge_knowledge_at(outcomes, sigs.select("incident_id", F.col("signal_us").alias("us")))
    return learning.edge_knowledge(outcomes)


def remember(events: DataFrame, learn: bool = True, clustered_templates: bool = False, as_of: bool = True) -> Memory:
    """Build the derived tables. With ``learn`` the chains are walked twice: the
    outcomes of the first pass give success rates and weights for the second.

    ``as_of`` lets a signal see only what was known before it: outcomes, weights and
    incidents closed by then. Without it the whole log is known, later events included.
    """
    ids = identity.identities(identity.renames(events))
    sigs = cut(windows.signals(events, ids))
    deps = cut(topology.live_dependencies(events, ids))
    nbrs = cut(topology.neighbours(deps))
    rems = E.remediations(events)
    causes = cut(causal.candidate_causes(sigs, events, ids))
    graded = learning.graded(rems, sigs, ids)
    chains = causal.chains(sigs, causes, nbrs)
    outcomes = learning.edge_outcomes(graded, chains)
    if learn:
        chains = causal.chains(sigs, causes, nbrs, cut(learned_edges(cut(outcomes), sigs, as_of)))
        outcomes = learning.edge_outcomes(graded, chains)
    facts = features.event_facts(templated(events, clustered_templates), ids)
    feats = features.incident_features(sigs, features.incident_items(sigs, facts))
    eps = cut(E.episodes(sigs, feats, chains, events, ids, deps, nbrs, rems))
    return Memory(events, ids, sigs, deps, nbrs, rems, chains, eps, graded, outcomes, as_of)


def looks_like_decoy(matches: DataFrame) -> DataFrame:
    """(query_id, decoy): first score below the floor, or no family twice in the
    first three. Queries without matches are decoys too; they have no row here."""
    top3 = matches.where(F.col("rank") <= 3)
    per_family = top3.where("family IS NOT NULL").groupBy("query_id", "family").agg(F.count(F.lit(1)).alias("n"))
    agree = per_family.groupBy("query_id").agg(F.sum("n").alias("known"), F.max("n").alias("most"))
    first = top3.groupBy("query_id").agg(F.min_by("score", "rank").alias("first_score"))
    return first.join(agree, "query_id", "left").select("query_id", "first_score", (
        (F.col("first_score") < DECOY_FLOOR) | (F.coalesce("known", F.lit(0)) < 2) | (F.coalesce("most", F.lit(0)) < 2)
    ).alias("decoy"))


def related_events(sigs: DataFrame, chains: DataFrame, events: DataFrame, cap: int = 30) -> DataFrame:
    """(incident_id, event_id, us): the chain's events, the signal, then the window's
    earliest events up to ``cap`` in all. The chain is never cut."""
    first, last = F.element_at("steps", 1), F.reverse("steps")
    nodes = F.concat(F.transform(last, lambda s: F.struct(s["event_id"].alias("event_id"), s["us"].alias("us"))),
                     F.array(F.struct(first["effect_event_id"].alias("event_id"), first["effect_us"].alias("us"))))
    chain = chains.where(F.size("steps") > 0).select("incident_id", F.explode(nodes).alias("e")).select("incident_id", "e.*", F.lit(0).alias("prio"))
    signal = sigs.where("signal_sec IS NOT NULL").select(
        "incident_id", F.col("signal_event_id").alias("event_id"), F.col("signal_us").alias("us"), F.lit(1).alias("prio"))
    # Of the window's earliest ``cap`` events enough are neither on the chain nor the signal.
    early = windows.first_events(sigs, events, cap).withColumn("prio", F.lit(2))
    ranked = chain.unionByName(signal).unionByName(early).groupBy("incident_id", "event_id").agg(
        F.min("us").alias("us"), F.min("prio").alias("prio"))
    w = Window.partitionBy("incident_id").orderBy("prio", "us", "event_id")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).select(
        "incident_id", "event_id", "us", "prio")


def overall_confidence(first_match: Column, best_edge: Column, best_remediation: Column) -> Column:
    zero = F.lit(0.0)
    return clip(0.5 * F.coalesce(first_match, zero) + 0.25 * F.coalesce(best_edge, zero)
                + 0.25 * F.coalesce(best_remediation, zero) + 0.05, 0.0, 1.0)


def narrative(incident: Column, service: Column, trigger: Column, clauses: Column, labels: Column, matches: Column,
              suggestions: Column) -> Column:
    """Lines about the signal, what to try, what led to it and what it resembles.

    ``clauses``: texts per edge; ``labels``: chain node labels in order;
    ``matches``: structs with incident_id, similarity, rationale; ``suggestions``:
    structs with action, target, historical_outcome, confidence.
    """
    best, first = F.get(matches, F.lit(0)), F.get(suggestions, F.lit(0))
    more = F.size(matches) - 1
    return F.concat_ws(
        "\n",
        F.concat(incident, F.lit(": "), F.coalesce(S.blank_to_null(trigger), F.lit("no trigger given")), F.lit(", seen on "),
                 F.coalesce(service, F.lit("no known service"))),
        F.when(F.size(suggestions) > 0, F.concat(
            F.lit("Try "), first["action"], F.lit(" of "), first["target"], F.lit(" ["), S.two_places(first["confidence"]), F.lit("; "), first["historical_outcome"], F.lit("]"))),
        F.when(F.size(clauses) > 0, F.concat(F.lit("Led up to by: "), F.array_join(clauses, " / "))).otherwise("Nothing in the window explains it"),
        F.when(F.size(clauses) > 0, F.concat(F.lit("In short: "), F.array_join(labels, " > "))),
        F.when(more >= 0, F.concat(F.lit("Resembles "), best["incident_id"], F.lit(" ["), S.two_places(best["similarity"]), F.lit("]: "), best["rationale"],
                                   F.when(more > 0, F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise("")))
        .otherwise("Resembles no closed incident"),
    )


def short_narrative(incident: Column, service: Column, n_edges: Column, past: Column, action: Column, target: Column,
                    confidence: Column) -> Column:
    return F.concat_ws(
        ", ", F.concat(incident, F.lit(" ("), service, F.lit(")")), F.concat(n_edges.cast("string"), F.lit(" causes found")),
        F.coalesce(F.concat(F.lit("like "), past), F.lit("like nothing before")),
        F.coalesce(F.concat(F.lit("try "), action, F.lit(" of "), F.coalesce(target, F.lit("?"))), F.lit("nothing to try")),
        F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit(" % sure")))


def _chain_text(chains: DataFrame, events: DataFrame) -> DataFrame:
    """(incident_id, clauses, labels): each chain event is fetched once by id."""
    def text(e):
        return F.struct(S.describe(e).alias("d"), S.node_label(e).alias("l"))

    nodes = chains.select("incident_id", F.posexplode(causal.node_ids(F.col("steps"))).alias("pos", "event_id"))
    said = events.select("event_id", text(lambda c: F.col(c)).alias("t"))
    seq = F.array_sort(F.collect_list(F.struct("pos", "t")))
    per = nodes.join(said, "event_id").groupBy("incident_id").agg(seq.alias("nodes"))
    edges = chains.select("incident_id", causal.forward(F.col("steps")).alias("edges"))
    clause = F.transform("edges", lambda e, i: F.concat(
        F.get("nodes", i)["t"]["d"], F.lit(", then "), F.get("nodes", i + 1)["t"]["d"], F.lit(" ["), S.two_places(e["confidence"]), F.lit("]")))
    return per.join(edges, "incident_id").select(
        "incident_id", clause.alias("clauses"), F.transform("nodes", lambda n: n["t"]["l"]).alias("labels"))


def pattern_boost(memory: Memory) -> DataFrame:
    """(incident_id, boost): mean decayed weight of the query's own causal pattern."""
    edges = memory.episodes.select("incident_id", "signal_us", F.explode("pattern").alias("p"))
    pair = F.concat_ws("->", "cause_kind", "effect_kind").alias("p")
    value = F.coalesce(causal.decayed(F.col("weight"), F.col("last_us"), F.col("signal_us")), F.lit(0.0))
    if memory.as_of:
        asked = memory.sigs.select("incident_id", F.col("signal_us").alias("us"))
        w = learning.edge_knowledge_at(memory.edge_outcomes, asked).select("incident_id", pair, "weight", "last_us")
        told = edges.join(w, ["incident_id", "p"], "left")
    else:
        # At most one row per kind pair of the affinity table, hence the broadcast.
        w = learning.edge_weights(memory.edge_outcomes).select(pair, "weight", "last_us")
        told = edges.join(F.broadcast(w), "p", "left")
    return told.groupBy("incident_id").agg(similarity.relationship_boost(F.avg(value)).alias("boost"))


def find_matches(memory: Memory, k: int, lsh: tuple[int, int] | None = None, feedback: bool = True) -> DataFrame:
    """Ranked matches of every incident. With ``feedback`` the first three matches,
    graded by the incident's remediations, adjust pair scores in a second search."""
    as_of = memory.as_of
    past = similarity.past_view(memory.episodes)
    boost = pattern_boost(memory)
    queries = cut(similarity.query_view(memory.episodes).join(boost, "incident_id", "left").fillna(0.0, ["boost"]))
    found = similarity.find_similar(queries, past, k, as_of, lsh=lsh)
    if not feedback or as_of:
        # A pair's grade is known only after the query's own remediation, so an
        # answer given at signal time cannot use it.
        return similarity.with_rationale(found, queries, past)
    weights = cut(learning.pair_weights(learning.pair_updates(found, memory.graded)))
    again = similarity.find_similar(queries, past, k, as_of, weights, lsh)
    return similarity.with_rationale(again, queries, past)


def context(memory: Memory, mode: str = "fast", lsh: tuple[int, int] | None = None,
            matches: DataFrame | None = None) -> DataFrame:
    """One row per signal. ``matches`` may be given when they are already known.

    What a signal may know of later events was decided when ``memory`` was built.
    """
    k, cap = similarity.TOP_K[mode], RELATED_CAP[mode]
    steps = "steps_fast" if mode == "fast" else "steps"
    chains = memory.episodes.select("incident_id", F.col(steps).alias("steps"))
    base = memory.episodes.select(
        "incident_id", "signal_us", "trigger", "own_id", "service", "affected_name", F.col(steps).alias("steps"), "symptoms", "latency_over")
    base = identity.resolve_at(base, identity.renames(memory.events), "affected_name", "signal_us", "at_service")

    if matches is None:
        matches = cut(find_matches(memory, k, lsh))
    decoy = looks_like_decoy(matches)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "incident_id", "score", "rationale"))), lambda m: F.struct(
        m["incident_id"].alias("incident_id"), m["score"].alias("score"), m["rationale"].alias("rationale")))
    matched = matches.groupBy(F.col("query_id").alias("incident_id")).agg(listed.alias("raw"))

    asked = base.select(F.col("incident_id").alias("query_id"), "signal_us", F.col("own_id").alias("service_id"), "service")
    tried = remediation.support(matches, memory.rems, memory.ids, asked if memory.as_of else None)
    ranked = cut(remediation.rank_remediations(remediation.known(cut(tried), asked, memory.graded, memory.as_of)))
    flags = remediation.window_flags(memory.episodes).join(
        base.select(F.col("incident_id").alias("query_id"), F.col("at_service").alias("service")), "query_id")
    guesses = remediation.fallback(flags.join(ranked.select("query_id").distinct(), "query_id", "left_anti"))
    columns = ["query_id", "rank", "action", "target", "historical_outcome", "confidence"]
    offers = ranked.select(*columns).unionByName(guesses.select(*columns))
    offered = offers.groupBy(F.col("query_id").alias("incident_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(*columns[1:]))), lambda r: F.struct(*[r[c].alias(c) for c in columns[2:]])).alias("offers"))

    near = related_events(memory.sigs, chains, memory.events, cap)
    shown = memory.events.select("event_id", F.struct("ts", "kind", "service", "target", "name", "value", "level", "msg", "action").alias("event"))
    related = near.join(shown, "event_id").groupBy("incident_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("us", "event_id", "event"))),
        lambda r: F.struct(r["event_id"].alias("event_id"), r["event"]["ts"].alias("ts"), r["event"]["kind"].alias("kind"),
                           r["event"]["service"].alias("service"), r["event"]["target"].alias("target"), r["event"]["name"].alias("name"),
                           r["event"]["value"].alias("value"), r["event"]["level"].alias("level"), r["event"]["msg"].alias("msg"),
                           r["event"]["action"].alias("action"))).alias("related_events"))

    def none(kind: str) -> Column:
        return F.array().cast(kind)

    raw_type, offer_type = dict(matched.dtypes)["raw"], dict(offered.dtypes)["offers"]
    rows = (
        base.join(matched, "incident_id", "left")
        .join(decoy.withColumnRenamed("query_id", "incident_id"), "incident_id", "left")
        .join(offered, "incident_id", "left").join(related, "incident_id", "left")
        .join(_chain_text(chains, memory.events), "incident_id", "left")
        .withColumn("decoy", F.coalesce("decoy", F.lit(True)))
        .withColumn("raw", F.coalesce("raw", none(raw_type))).withColumn("offers", F.coalesce("offers", none(offer_type)))
        .withColumn("causal_chain", causal.forward(F.col("steps")))
        .withColumn("similar_past_incidents", F.transform("raw", lambda m: F.struct(
            m["incident_id"].alias("incident_id"),
            F.round(F.when(F.col("decoy"), F.least(m["score"], F.lit(DECOY_SIMILARITY))).otherwise(m["score"]), 4).alias("similarity"),
            m["rationale"].alias("rationale"))))
        .withColumn("suggested_remediations", F.transform("offers", lambda r: F.struct(
            r["action"].alias("action"), r["target"].alias("target"), r["historical_outcome"].alias("historical_outcome"),
            F.when(F.col("decoy"), F.least(r["confidence"], F.lit(DECOY_CONFIDENCE))).otherwise(r["confidence"]).alias("confidence"))))
        .withColumn("confidence", F.round(overall_confidence(
            F.col("first_score"), F.array_max(F.transform("causal_chain", lambda e: e["confidence"])),
            F.array_max(F.transform("suggested_remediations", lambda r: r["confidence"]))), 4))
    )
    story_matches = F.transform("raw", lambda m: F.struct(
        m["incident_id"].alias("incident_id"), m["score"].alias("similarity"), m["rationale"].alias("rationale")))
    empty = none("array<string>")
    return rows.select(
        "incident_id", F.coalesce("related_events", none(dict(related.dtypes)["related_events"])).alias("related_events"),
        "causal_chain", "similar_past_incidents", "suggested_remediations", "confidence",
        narrative(F.col("incident_id"), F.col("at_service"), F.col("trigger"), F.coalesce("clauses", empty),
                  F.coalesce("labels", empty), story_matches, F.col("suggested_remediations")).alias("explain"))
