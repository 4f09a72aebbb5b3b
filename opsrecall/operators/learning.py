"""What closed incidents teach: success rates, decayed weights, pair weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsrecall.functions import scalars as S
from opsrecall.functions.folds import clipped_at, clipped_fold
from opsrecall.operators.causal import HALF_LIFE_S, KIND_AFFINITY
from opsrecall.operators.identity import with_identity
from opsrecall.session import cut

# ---- fixed values ----
EDGE_UP, EDGE_DOWN = 0.08, -0.05
ACTION_UP, ACTION_DOWN = 0.10, -0.06
PAIR_STEP, PAIR_LIMIT = 0.05, 0.2
KEPT_MATCHES = 3
# ----------------------


def event_counts(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(identity_id, kind, n). Counted per raw name before renames are looked up."""
    raw = (
        events.select("kind", S.event_service().alias("name")).where("kind IS NOT NULL AND kind <> '' AND name IS NOT NULL")
        .groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))
    )
    return with_identity(raw, ids, "name", "identity_id", spread_by="kind").groupBy("identity_id", "kind").agg(F.sum("n").alias("n"))


def graded(rems: DataFrame, sigs: DataFrame, ids: DataFrame) -> DataFrame:
    """Remediations that followed their signal, with success and target identity."""
    after = rems.join(sigs.select("incident_id", "signal_event_id"), "incident_id").where("event_id > signal_event_id")
    got = after.select("incident_id", F.col("event_id").alias("seq"), "us", "action",
                       S.blank_to_null(F.col("target")).alias("target"), S.is_success(F.col("outcome")).alias("success"))
    return with_identity(got, ids, "target", "target_id", spread_by="seq")


def edge_outcomes(graded_rems: DataFrame, chains: DataFrame) -> DataFrame:
    """One row per chain edge and remediation of its incident."""
    edges = chains.select("incident_id", F.explode("steps").alias("s")).select(
        "incident_id", F.col("s.step").alias("step"), F.col("s.kind").alias("cause_kind"), F.col("s.effect_kind").alias("effect_kind"),
        F.col("s.cause_id").alias("cause_id"), F.col("s.effect_id").alias("effect_id"))
    return edges.join(graded_rems.select("incident_id", "seq", "us", "success"), "incident_id")


def _stats(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.max("us").alias("last_us"),
    ).withColumn("success_rate", F.col("n_success") / F.col("n"))


def kind_edge_stats(outcomes: DataFrame) -> DataFrame:
    return _stats(outcomes, ["cause_kind", "effect_kind"])


def service_edge_stats(outcomes: DataFrame) -> DataFrame:
    return _stats(outcomes.where("cause_id IS NOT NULL AND effect_id IS NOT NULL"), ["cause_id", "effect_id"])


def remediation_stats(graded_rems: DataFrame) -> DataFrame:
    """(target_id, action, n, n_success, success_rate): rows per service and
    action, and rows with a null service over all services."""
    rows = graded_rems.where("action IS NOT NULL AND action <> ''")
    # Both levels from one pass: services first, then the few sums per action.
    per = rows.groupBy("target_id", "action").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"))
    total = per.groupBy("action").agg(F.sum("n").alias("n"), F.sum("n_success").alias("n_success"))
    return per.where("target_id IS NOT NULL").unionByName(
        total.select(F.lit(None).cast("string").alias("target_id"), "action", "n", "n_success")
    ).withColumn("success_rate", F.col("n_success") / F.col("n"))


def success_lookup(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """Add `knowledge_rate` to ``wanted(service_id, action, ...)``: the service's own
    row, else the action's, else 0."""
    own = stats.where("target_id IS NOT NULL").select(F.col("target_id").alias("service_id"), "action", F.col("success_rate").alias("_own"))
    any_ = stats.where("target_id IS NULL").select("action", F.col("success_rate").alias("_any"))
    return (
        wanted.join(own, ["service_id", "action"], "left").join(any_, "action", "left")
        .withColumn("knowledge_rate", F.coalesce("_own", "_any", F.lit(0.0))).drop("_own", "_any")
    )


def _delta(up: float, down: float):
    return F.when(F.col("success"), up).otherwise(down).alias("delta")


def edge_updates(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        F.concat_ws(">", "cause_kind", "effect_kind").alias("key"), "us",
        # A chain is graded root cause first, and `step` counts from the signal.
        (F.col("seq") * 8 + 7 - F.col("step")).alias("seq"), _delta(EDGE_UP, EDGE_DOWN))


def edge_weights(outcomes: DataFrame, **kw) -> DataFrame:
    """(cause_kind, effect_kind, weight, last_us) as of the last update."""
    rows = edge_updates(outcomes)
    return clipped_fold(rows, -1.0, 1.0, HALF_LIFE_S, **kw).select(
        F.split("key", ">")[0].alias("cause_kind"), F.split("key", ">")[1].alias("effect_kind"), "weight", "last_us")


def _numbered(asked: DataFrame) -> DataFrame:
    return cut(asked.withColumn("question", F.monotonically_increasing_id()))


def edge_knowledge_at(outcomes: DataFrame, asked: DataFrame, **kw) -> DataFrame:
    """(incident_id, cause_kind, effect_kind, n, success_rate, weight, last_us): for
    ``asked(incident_id, us)`` and every pair of kinds that can be an edge, what was
    learned before that time. Pairs without an outcome by then have no row."""
    pairs = F.explode(F.array(*[F.lit(f"{c}>{e}") for c, e in KIND_AFFINITY]))
    questions = _numbered(asked.where("us IS NOT NULL").select("incident_id", "us", pairs.alias("key")))
    known = clipped_at(edge_updates(outcomes), questions, -1.0, 1.0, HALF_LIFE_S, **kw).where("n > 0")
    return known.join(questions, "question").select(
        "incident_id", F.split("key", ">")[0].alias("cause_kind"), F.split("key", ">")[1].alias("effect_kind"),
        "n", (F.col("ups") / F.col("n")).alias("success_rate"), "weight", "last_us")


def remediation_knowledge_at(graded_rems: DataFrame, asked: DataFrame, **kw) -> DataFrame:
    """``asked(query_id, service_id, action, us)`` with `knowledge_rate`, `weight` and `last_us`
    as of ``us``: the success rate of the action on the service, else anywhere, else 0, and
    the action's weight."""
    rows = graded_rems.where("action IS NOT NULL AND action <> ''")
    columns = ["key", "us", "seq", "delta"]
    updates = action_updates(rows).select(*columns).unionByName(service_updates(rows).select(*columns))
    questions = _numbered(asked.select("query_id", "service_id", "action", "us", F.posexplode(F.array(
        F.col("action"), F.concat_ws("\u0001", "action", F.coalesce("service_id", F.lit("\u0001"))))).alias("own", "key")))
    known = clipped_at(updates, questions.where("us IS NOT NULL"), -1.0, 1.0, HALF_LIFE_S, **kw)
    told = questions.join(known, "question", "left").groupBy("query_id", "service_id", "action").agg(
        *[F.max(F.when((F.col("own") == own) & (F.col("n") > 0), F.struct("n", "ups", "weight", "last_us"))).alias(name) for name, own in (("_any", 0), ("_own", 1))])

    def rate(c: str):
        return F.col(f"{c}.ups") / F.col(f"{c}.n")

    return told.select("query_id", "service_id", "action", F.coalesce(rate("_own"), rate("_any"), F.lit(0.0)).alias("knowledge_rate"),
                       F.col("_any.weight").alias("weight"), F.col("_any.last_us").alias("last_us"))


def action_updates(graded_rems: DataFrame) -> DataFrame:
    return graded_rems.where("action IS NOT NULL AND action <> ''").select(
        F.col("action").alias("key"), "us", "seq", _delta(ACTION_UP, ACTION_DOWN))


def service_updates(graded_rems: DataFrame) -> DataFrame:
    """As ``action_updates``, for an action on a service."""
    return graded_rems.where("action IS NOT NULL AND action <> '' AND target_id IS NOT NULL").select(
        F.concat_ws("\u0001", "action", "target_id").alias("key"), "us", "seq", _delta(ACTION_UP, ACTION_DOWN))


def action_weights(graded_rems: DataFrame, **kw) -> DataFrame:
    """(action, weight, last_us)."""
    rows = action_updates(graded_rems)
    return clipped_fold(rows, -1.0, 1.0, HALF_LIFE_S, **kw).select(F.col("key").alias("action"), "weight", "last_us")


def pair_updates(matches: DataFrame, graded_rems: DataFrame, keep: int = KEPT_MATCHES) -> DataFrame:
    """(a, b, us, seq, delta): the first matches of an incident, graded by its remediations."""
    kept = matches.where(F.col("rank") <= keep).select(
        F.col("query_id").alias("incident_id"), F.col("incident_id").alias("past_id"), "rank")
    return kept.join(graded_rems.select("incident_id", "seq", "us", "success"), "incident_id").select(
        F.least("incident_id", "past_id").alias("a"), F.greatest("incident_id", "past_id").alias("b"), "us",
        (F.col("seq") * 8 + F.col("rank")).alias("seq"), _delta(PAIR_STEP, -PAIR_STEP))


def pair_rows(updates: DataFrame) -> DataFrame:
    return updates.select(F.concat_ws("\u0001", "a", "b").alias("key"), "us", "seq", "delta")


def pair_weights(updates: DataFrame, **kw) -> DataFrame:
    """(a, b, w): clipped sum of a pair's updates in order."""
    rows = pair_rows(updates)
    return clipped_fold(rows, -PAIR_LIMIT, PAIR_LIMIT, None, **kw).select(
        F.split("key", "\u0001")[0].alias("a"), F.split("key", "\u0001")[1].alias("b"), F.col("weight").alias("w"))


def edge_knowledge(outcomes: DataFrame, **kw) -> DataFrame:
    """Success rate and weight per kind pair in one table for chain scoring."""
    w = edge_weights(outcomes, **kw).select("cause_kind", "effect_kind", "weight", "last_us")
    return kind_edge_stats(outcomes).drop("last_us").join(w, ["cause_kind", "effect_kind"])
