"""Signals and the interval join of signals with the events around them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from opsrecall.functions import scalars as S
from opsrecall.operators.identity import with_identity
from opsrecall.operators.skew import ROWS_PER_TASK, salted_join
from opsrecall.session import cut
from opsrecall.sources.events import with_event_ids

# Bins of an interval; pairs that a salt of a bin, and a task, should make; the most tasks of a join.
STEPS = 6
PAIRS_OF_BIN, PAIRS_OF_TASK = 100_000_000, 10_000_000
MOST_TASKS = 10_000


def signals(events: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per incident: its first signal.

    `affected` is the service named by the field or parsed from the trigger and
    gives the roles of tokens; `own` comes from the field alone and is what
    topology, graph roles and the episode's service name go by.
    """
    row = F.min_by(F.struct("event_id", "us", "sec", "service", "target", "trigger", "family"), "event_id").alias("r")
    first = (
        events.where((F.col("kind") == "incident_signal") & (F.coalesce("incident_id", F.lit("")) != ""))
        .groupBy("incident_id").agg(row)
        .select(
            "incident_id", F.col("r.event_id").alias("signal_event_id"), F.col("r.us").alias("signal_us"),
            F.col("r.sec").alias("signal_sec"), F.col("r.trigger").alias("trigger"), F.col("r.family").alias("family"),
            S.affected_service(F.col("r.service"), F.col("r.trigger")).alias("affected_name"),
            S.event_service(F.col("r.service"), F.col("r.target")).alias("own_name"))
    )
    first = with_identity(first, ids, "affected_name", "affected_id", "affected_now", spread_by="signal_event_id")
    return with_identity(first, ids, "own_name", "own_id", "own_now", spread_by="signal_event_id")


def interval_join(sigs: DataFrame, rows: DataFrame, spread_by: str, before_s: int = S.WINDOW_BEFORE_S,
                  after_s: int = S.WINDOW_AFTER_S, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs with signal_sec - before_s <= rows.sec <= signal_sec + after_s.

    Time is cut into bins of a part of the interval and the join is an equality on the bin, so
    that few pairs are made that the exact condition drops again. Bins with many ``rows``, or many
    pairs, are salted by ``spread_by``. The number of tasks follows the number of pairs, which
    grows faster than the rows that are read.
    """
    width = max(1, (before_s + after_s) // STEPS)
    lo, hi = F.col("signal_sec") - before_s, F.col("signal_sec") + after_s
    left = sigs.where("signal_sec IS NOT NULL").withColumn(
        "_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    right = rows.where("sec IS NOT NULL").withColumn("_bin", F.floor(F.col("sec") / width))
    held = cut(
        right.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).join(left.groupBy("_bin").agg(F.count(F.lit(1)).alias("m")), "_bin")
        .withColumn("splits", F.greatest(F.ceil(F.col("n") / rows_per_task), F.least("n", F.ceil(F.col("n") * F.col("m") / PAIRS_OF_BIN))).cast("int")))
    pairs = held.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    hot = held.where("splits > 1").select("_bin", "splits")
    salt = F.coalesce("splits", F.lit(1))
    right = right.join(hot, "_bin", "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salt.cast("long")).cast("int")).drop("splits")
    left = left.join(hot, "_bin", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salt - 1))).drop("splits")
    if pairs > PAIRS_OF_TASK:
        tasks = min(MOST_TASKS, max(math.ceil(pairs / PAIRS_OF_TASK), 2 * sigs.sparkSession.sparkContext.defaultParallelism))
        left, right = left.repartition(tasks, "_bin", "_salt"), right.repartition(tasks, "_bin", "_salt")
    return right.join(left, ["_bin", "_salt"]).drop("_bin", "_salt").where(F.col("sec").between(lo, hi))


def window_events(sigs: DataFrame, events: DataFrame, columns: list[str] | None = None, **kw) -> DataFrame:
    """The events around each signal; `dt_s` is event time minus signal time.
    Each (incident_id, event_id) occurs once since an event has one bin."""
    columns = columns or ["event_id", "us", "kind"]
    slim = events.select(*dict.fromkeys([*columns, "event_id", "us", "sec"]))
    keep = sigs.select("incident_id", "signal_event_id", "signal_us", "signal_sec",
                       *[c for c in sigs.columns if c in ("affected_id", "own_id")])
    pairs = interval_join(keep, slim, "event_id", **kw)
    return pairs.withColumn("dt_s", (F.col("us") - F.col("signal_us")) / 1_000_000.0).drop("sec")


def first_events(sigs: DataFrame, events: DataFrame, n: int, before_s: int = S.WINDOW_BEFORE_S,
                 after_s: int = S.WINDOW_AFTER_S, columns: tuple[str, ...] = ()) -> DataFrame:
    """(incident_id, event_id, us, ``columns``): the earliest ``n`` events of each signal's window.

    Events are numbered by (us, event_id). The number of the first one in a window is that of
    its beginning among events and beginnings, less its number among beginnings alone. So a
    signal meets two blocks of ``n`` events, however many its window holds.
    """
    slim = events.where("sec IS NOT NULL").select(*dict.fromkeys(["event_id", "us", "sec", *columns]))
    placed = with_event_ids(slim, ["us", "event_id"], into="place").withColumn("_block", F.floor(F.col("place") / n))
    begins = sigs.where("signal_sec IS NOT NULL").select(
        "incident_id", "signal_sec", ((F.col("signal_sec") - before_s) * 1_000_000).alias("us"))
    # Equal rows share their numbers in any way, but not what they are of: a beginning stands before its events.
    alone = with_event_ids(begins, ["us", "incident_id"], into="_among")
    mixed = begins.select("us", F.lit(0).alias("turn"), "incident_id", F.lit(None).cast("bigint").alias("event_id")).unionByName(
        slim.select("us", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("incident_id"), "event_id"))
    mixed = with_event_ids(mixed, ["us", "turn", "incident_id", "event_id"], into="_mixed").where("turn = 0").select("incident_id", "_mixed")
    asked = alone.join(mixed, "incident_id").select(
        "incident_id", "signal_sec", (F.col("_mixed") - F.col("_among")).alias("_first")).withColumn(
        "_block", F.explode(F.array(F.floor(F.col("_first") / n), F.floor(F.col("_first") / n) + 1)))
    met = salted_join(cut(asked), placed, ["_block"], "incident_id")
    return met.where((F.col("place") >= F.col("_first")) & (F.col("place") < F.col("_first") + n)
                     & (F.col("sec") <= F.col("signal_sec") + after_s)).select("incident_id", *dict.fromkeys(["event_id", "us", *columns]))


def count_per_second(events: DataFrame) -> DataFrame:
    return events.where("sec IS NOT NULL").groupBy("sec").agg(F.count(F.lit(1)).alias("n_events"))


def same_service_baseline(events: DataFrame, within_s: int = 1800, n_events: int = 20, n_matches: int = 5) -> DataFrame:
    """The plain reference point: exact service name, events within 30 minutes,
    the first prior signals of that name, the first remediation among them.

    Each name keeps only the first signals it can ever return before anything
    is joined, so a busy name costs no more than a quiet one.
    """
    from pyspark.sql import Window

    sig = events.where((F.col("kind") == "incident_signal") & F.col("incident_id").isNotNull()).select(
        "incident_id", "event_id", "us", F.coalesce("service", F.lit("")).alias("service"))
    by_name = Window.partitionBy("service").orderBy("event_id")
    # One spare row, because a signal does not match itself.
    firsts = sig.withColumn("rn", F.row_number().over(by_name)).where(F.col("rn") <= n_matches + 1).select(
        "service", F.col("incident_id").alias("past_id"), F.col("rn"))
    per_q = Window.partitionBy("incident_id").orderBy("rn")
    matches = (
        sig.join(firsts, "service").where("past_id <> incident_id")
        .withColumn("rank", F.row_number().over(per_q)).where(F.col("rank") <= n_matches)
    )
    last_rem = events.where("kind = 'remediation' AND incident_id IS NOT NULL").groupBy("incident_id").agg(
        F.max_by(F.struct("action", F.coalesce("target", F.lit("")).alias("target"), "outcome"), "event_id").alias("rem"))
    best = (
        matches.join(last_rem.withColumnRenamed("incident_id", "past_id"), "past_id", "left")
        .groupBy("incident_id").agg(
            F.count(F.lit(1)).alias("n_matches"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "past_id"))), lambda x: x["past_id"]), ",").alias("matches"),
            F.min_by("rem", F.when(F.col("rem").isNotNull(), F.col("rank"))).alias("rem"))
    )
    related = interval_join(
        sig.select("incident_id", F.col("us").alias("signal_us"), F.floor(F.col("us") / 1_000_000).alias("signal_sec"), "service"),
        events.select(F.coalesce(S.blank_to_null(F.col("service")), S.blank_to_null(F.col("target")), S.blank_to_null(F.col("from_"))).alias("ev_service"),
                      "event_id", "us", "sec"),
        "event_id", within_s + 1, within_s + 1,
    ).where((F.col("service") == F.col("ev_service")) & (F.abs(F.col("us") - F.col("signal_us")) <= within_s * 1_000_000))
    n_rel = related.groupBy("incident_id").agg(F.least(F.count(F.lit(1)), F.lit(n_events)).alias("n_related"))
    return sig.join(best, "incident_id", "left").join(n_rel, "incident_id", "left").select(
        "incident_id", F.coalesce("n_related", F.lit(0)).alias("n_related"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("matches", F.lit("")).alias("matches"),
        F.col("rem.action").alias("action"), F.col("rem.target").alias("target"))
