"""Events so dense that signals and the events around them must not be paired, against brute force."""

import random
import re

import pytest

from opsrecall.operators import causal, windows
from opsrecall.plans import catalog
from opsrecall.plans.landing import landing

KINDS = [("deploy", 0.6), ("log", 0.8), ("log", 0.0), ("metric", 0.8), ("metric", 0.4), ("topology", 0.4), ("trace", 0.0)]
TABLES = {
    "causes": "event_id bigint, us bigint, sec bigint, kind string, share double, cause_id string, label string",
    "sigs": "incident_id string, signal_event_id bigint, signal_us bigint, signal_sec bigint, own_id string",
    "nbrs": "identity_id string, neighbour_id string",
    "stats": "cause_kind string, effect_kind string, success_rate double, weight double, last_us bigint",
}


def dense(n: int, n_signals: int):
    """Causes over some hours around a bin's edge, half of them in one minute; several share a time."""
    rnd = random.Random(4)
    services = ["a", "b", "c", "d", "e", None]
    base = 5 * causal.BIN_US

    def when():
        return base + (rnd.randrange(60_000) * 1000 if rnd.random() < 0.5 else rnd.randrange(-4_000, 4_000) * 1_000_000)

    causes = {}
    for i in range(n):
        us, (kind, share), svc = when(), rnd.choice(KINDS), rnd.choice(services)
        causes.setdefault((us, kind, share, svc), (i, us, us // 1_000_000, kind, share, svc, kind))
    sigs = []
    for i in range(n_signals):
        us = when() + rnd.choice([0, 1, 60_000_000, 180_000_000])
        sigs.append((f"I-{i}", n + i, us, us // 1_000_000, rnd.choice(services)))
    return list(causes.values()), sigs, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def walk(sig, causes, nbrs, stats):
    """The chain of one signal, every cause looked at in every step."""
    _, effect_id, effect_us, sec, svc = sig
    kind, steps = "incident_signal", []
    pool = [c for c in causes if c[2] >= sec - 2400]
    for _ in range(causal.MAX_STEPS):
        best = None
        for c in pool:
            aff, dt = causal.KIND_AFFINITY.get((c[3], kind), 0.0), (effect_us - c[1]) / 1e6
            if dt <= 0 or not aff:
                continue
            t = next((s for upto, s in causal.TEMPORAL if dt <= upto), causal.TEMPORAL_REST)
            topo = 0.0 if c[5] is None or svc is None else 0.25 if c[5] == svc else 0.15 if (svc, c[5]) in nbrs else 0.0
            rate, weight, last = stats.get((c[3], kind), (0.0, 0.0, effect_us))
            rel = max(-0.5, min(0.5, weight * 0.5 ** (max(0.0, (effect_us - last) / 1e6) / causal.HALF_LIFE_S)))
            evid = min(1.0, c[4] + (0.2 if kind == "incident_signal" else 0.0))
            score = 0.30 * aff + 0.25 * t + 0.15 * rate + 0.15 * topo + 0.10 * evid + 0.05 * rel
            if best is None or (score, -c[1], -c[0]) > best[0]:
                best = (score, -c[1], -c[0]), c
        if best is None or best[0][0] < causal.MIN_CONFIDENCE * causal.DEEP_FACTOR:
            break
        c = best[1]
        steps.append(c[0])
        effect_id, effect_us, kind, svc = c[0], c[1], c[3], c[5]
    return steps


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("learned", [False, True])
def test_chains_of_dense_events(spark, monkeypatch, small, learned):
    causes, sigs, nbrs = dense(1500, 40)
    stats = {("deploy", "metric"): (0.5, 0.4, 0), ("log", "incident_signal"): (1.0, -0.9, 5 * causal.BIN_US)} if learned else {}
    if small:
        # Stretches are dealt to several tasks.
        monkeypatch.setattr(causal.leading_causes, "__defaults__", (100, 7))
    made = {k: spark.createDataFrame(v, TABLES[k]) for k, v in (("causes", causes), ("sigs", sigs), ("nbrs", nbrs))}
    told = spark.createDataFrame([(*k, *v) for k, v in stats.items()], TABLES["stats"]) if learned else None
    got = {r["incident_id"]: [s["event_id"] for s in r["steps"]]
           for r in causal.chains(made["sigs"], made["causes"], made["nbrs"], told).collect()}
    want = {s[0]: walk(s, causes, set(nbrs), stats) for s in sigs}
    assert got == {k: v for k, v in want.items() if v}


def test_few_causes_lead_however_many_there_are(spark):
    causes, sigs, nbrs = dense(3000, 10)
    pool = spark.createDataFrame(causes, TABLES["causes"]).selectExpr("*", f"FLOOR(us / {causal.BIN_US}) AS _bin")
    look = spark.createDataFrame(sigs, TABLES["sigs"]).selectExpr(
        "incident_id", "(signal_sec - 2400) * 1000000 AS lo_us", "signal_event_id AS effect_event_id", "signal_us AS effect_us",
        "'incident_signal' AS effect_kind", "own_id AS effect_id", "array('b') AS nbrs",
        "CAST(NULL AS map<string,struct<rate:double,weight:double,last_us:bigint>>) AS hist")
    assert 0 < causal.leading_causes(look, pool).count() <= len(sigs) * 2 * 4 * len(KINDS)


def test_first_events_of_dense_windows(spark):
    causes, sigs, _ = dense(1500, 40)
    rows = [(c[0], c[1], c[2], c[3]) for c in causes] + [(-1, None, None, "log")]
    made = windows.first_events(spark.createDataFrame([*sigs, ("I-none", 9, None, None, None)], TABLES["sigs"]),
                                spark.createDataFrame(rows, "event_id bigint, us bigint, sec bigint, kind string"), 7, columns=("kind",))
    assert made.columns == ["incident_id", "event_id", "us", "kind"]
    want = {s[0]: [e[0] for e in sorted((e for e in rows[:-1] if s[3] - 2400 <= e[2] <= s[3] + 60), key=lambda e: (e[1], e[0]))][:7] for s in sigs}
    got: dict = {}
    for r in sorted(made.collect(), key=lambda r: (r["us"], r["event_id"])):
        got.setdefault(r["incident_id"], []).append(r["event_id"])
    assert got == {k: v for k, v in want.items() if v}


def test_first_events_make_few_rows(spark):
    """Every signal sees every event here: a full interval join would make 400 x 3,000 rows."""
    sigs = spark.range(400).selectExpr("CAST(id AS STRING) AS incident_id", "id + 5000 AS signal_event_id", "5000 * 1000000L AS signal_us", "5000L AS signal_sec")
    events = spark.range(3000).selectExpr("id AS event_id", "(4000 + id % 7) * 1000000 AS us", "4000 + id % 7 AS sec")
    got = windows.first_events(sigs, events, 5)
    assert got.count() == 400 * 5 and sorted(r[0] for r in got.select("event_id").distinct().collect()) == [0, 7, 14, 21, 28]


def test_pairs_of_signals_and_events_are_not_kept(spark):
    land = landing(spark, "/root/testdata/sf0.001")
    # A row for an event, not for each signal near it.
    assert "incident_id" not in land.causes.columns
    assert land.causes.count() <= land.events.count()
    plan = catalog.QUERIES["SET3"](land)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not re.search(r"hashpartitioning\(incident_id#\d+, event_id", plan)
