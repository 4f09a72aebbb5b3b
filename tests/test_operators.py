"""Operators against plain Python on small inputs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from opsrecall.functions import sets
from opsrecall.functions.folds import clipped_at, clipped_fold
from opsrecall.operators import evaluate, features, graphs, learning, remediation, replicas, similarity, skew, templates, topk, vectors, windows
from opsrecall.operators.graphs import connected_components
from opsrecall.plans.landing import landing
from opsrecall.session import cut
from opsrecall.sources import events as SRC

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def land(spark):
    return landing(spark, SF)


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert skew.hot_keys(big, ["k"], 500).collect()[0]["k"] == 7
    got = skew.salted_join(big, small, ["k"], "id", rows_per_task=100)
    want = big.join(small, "k")
    assert sorted(got.select("k", "id", "v").collect()) == sorted(want.select("k", "id", "v").collect())


def test_interval_join_edges(spark):
    random.seed(3)
    sig = [(f"i{n}", random.randrange(20_000)) for n in range(40)]
    ev = [(n, random.randrange(20_000)) for n in range(400)]
    s = spark.createDataFrame(sig, "incident_id string, signal_sec bigint")
    e = spark.createDataFrame(ev, "event_id bigint, sec bigint")
    got = windows.interval_join(s, e, "event_id", 2400, 60, rows_per_task=20)
    want = sorted((i, n) for i, a in sig for n, b in ev if a - 2400 <= b <= a + 60)
    assert sorted((r["incident_id"], r["event_id"]) for r in got.collect()) == want


def test_components(spark):
    random.seed(5)
    edges = [(f"n{random.randrange(300):03d}", f"n{random.randrange(300):03d}") for _ in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("half_life", [None, 500.0])
def test_clipped_fold(spark, half_life):
    """One key holds most rows; weights must not depend on how rows are partitioned."""
    random.seed(11)
    rows = [("hot" if random.random() < 0.7 else f"k{random.randrange(5)}", random.randrange(10_000) * 1_000_000, i, random.choice([0.1, -0.06, 0.3]))
            for i in range(600)]
    want: dict = {}
    for k, us, _seq, d in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        w, last = want.get(k, (0.0, us))
        f = 0.5 ** ((us - last) / 1e6 / half_life) if half_life else 1.0
        want[k] = (max(-0.2, min(0.2, w * f + d)), us)
    df = spark.createDataFrame(rows, "key string, us bigint, seq bigint, delta double").repartition(4)
    for parts in (1, 7):
        got = {r["key"]: r for r in clipped_fold(df, -0.2, 0.2, half_life, parts).collect()}
        assert set(got) == set(want)
        for k, (w, last) in want.items():
            assert got[k]["weight"] == pytest.approx(w, abs=1e-9) and got[k]["last_us"] == last
    assert got["hot"]["n_stretches"] > 1
    # Two halves in time, the second starting from the first.
    first, second = df.where("us < 5000000000"), df.where("us >= 5000000000")
    start = clipped_fold(first, -0.2, 0.2, half_life)
    then = {r["key"]: r["weight"] for r in clipped_fold(second, -0.2, 0.2, half_life, 3, start).collect()}
    assert then["hot"] == pytest.approx(want["hot"][0], abs=1e-9)


@pytest.mark.parametrize("half_life", [None, 500.0])
def test_weights_before_any_time(spark, half_life):
    """Every question sees the updates before its time, wherever batches and partitions are cut."""
    random.seed(13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rows = [("hot" if random.random() < 0.7 else f"k{random.randrange(5)}", random.randrange(4000) * 1_000_000, i, random.choice([0.1, -0.06, 0.3])) for i in range(600)]
    asked = [(i, random.choice(["hot", "k1", "k3", "never"]), random.randrange(-10, 4010) * 1_000_000) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, us bigint, seq bigint, delta double").repartition(4)
    ask = spark.createDataFrame(asked, "question bigint, key string, us bigint")
    try:
        for parts in (1, 6):
            got = {r["question"]: r for r in clipped_at(df, ask, -0.2, 0.2, half_life, parts).collect()}
            assert len(got) == 300
            for i, key, at in asked:
                w, last, n, ups = 0.0, None, 0, 0
                for _, us, _seq, d in sorted((r for r in rows if r[0] == key and r[1] < at), key=lambda r: (r[1], r[2])):
                    f = 0.5 ** ((us - last) / 1e6 / half_life) if half_life and last is not None else 1.0
                    w, last, n, ups = max(-0.2, min(0.2, w * f + d)), us, n + 1, ups + (d > 0)
                r = got[i]
                assert r["weight"] == pytest.approx(w, abs=1e-9) and (r["last_us"], r["n"], r["ups"]) == (last, n, ups), (i, key, at)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _templates(shapes, threshold=0.5):
    """Template of every shape: of the widest group by count and first tokens that agrees on enough places."""
    out, left = {}, [s.split(" ") for s in shapes]
    for depth in (0, 1, 2, 4, 8, 16, 32, 64, 128):
        groups = {}
        for t in left:
            groups.setdefault((len(t), tuple(t[:min(depth, math.ceil(threshold * len(t)))])), []).append(t)
        left = []
        for (n, _), rows in groups.items():
            pattern = [r[0] if len(set(r)) == 1 else "<*>" for r in zip(*rows, strict=True)]
            same = sum(len(set(r)) == 1 for r in zip(*rows, strict=True))
            if same >= math.ceil(threshold * n):
                out |= {" ".join(t): " ".join(pattern) for t in rows}
            else:
                left += rows
    assert not left
    return out


def _messages():
    random.seed(2)
    words = ["timeout", "calling", "retry", "svc-a", "svc-b", "ok", "user", "id=7", "failed"]
    made = [" ".join(random.choice(words) for _ in range(random.randrange(1, 8))) for _ in range(300)]
    made += [f"login of {chr(97 + i)}x from host" for i in range(26)] + [f"disk {n} of node is {s}" for n in "abc" for s in ("full", "slow", "gone")] + ["x " * 255 + "x", "y"]
    return made


def test_templates_depend_on_the_set_of_shapes_alone(spark):
    msgs = _messages()
    want = _templates({" ".join("<*>" if any(c.isdigit() for c in t) else t for t in re.findall(r"[A-Za-z0-9_.\-/:]+", m[:512])) for m in msgs})
    assert len(set(want.values())) > 5 and want["login of ax from host"] == "login of <*> from host"
    rows = [(i, m) for i, m in enumerate(msgs)]
    for turn, parts in ((rows, 1), (rows[::-1], 5), (sorted(rows, key=lambda r: hash(r[1])), 3)):
        df = spark.createDataFrame(turn, "us bigint, msg string").repartition(parts)
        got = {r["shape"]: r["pattern"] for r in templates.cluster(templates.shapes(df)).collect()}
        assert got == want
    # Parts of the log, counted apart, add up to the whole.
    first, second = (templates.shapes(spark.createDataFrame(r, "us bigint, msg string")) for r in (rows[:100], rows[100:]))
    both = templates.cluster(templates.merged(first.unionByName(second)))
    whole = templates.cluster(templates.shapes(spark.createDataFrame(rows, "us bigint, msg string")))
    assert sorted(both.collect()) == sorted(whole.collect())
    assert templates.cluster(whole.select("shape", "n_tokens", "freq", "first_seen", "last_seen").where("1 = 0")).count() == 0


def test_minhash_estimates_jaccard(spark):
    random.seed(9)
    rows = []
    for i in range(40):
        a = random.sample(range(200), 60)
        keep = random.randrange(60)
        b = a[:keep] + random.sample(range(300, 500), 60 - keep)
        rows.append((i, [f"t{x}" for x in a], [f"t{x}" for x in b]))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select(
        sets.jaccard(F.col("a"), F.col("b")).alias("j"), sets.estimated_jaccard(sets.minhash(F.col("a")), sets.minhash(F.col("b"))).alias("e"),
        F.arrays_overlap(sets.band_hashes(sets.minhash(F.col("a"))), sets.band_hashes(sets.minhash(F.col("b")))).alias("met"))
    for r in df.collect():
        assert abs(r["j"] - r["e"]) < 0.15
        assert r["met"] or r["j"] < 0.4
    empty = spark.range(1).select(sets.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"),
                                  sets.minhash(F.array().cast("array<string>")).alias("m")).first()
    assert empty["j"] == 0.0 and set(empty["m"]) == {0}


def _jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def _brute(eps, k, as_of, weights):
    """Every query against every closed incident, then turns among the same service."""
    out = {}
    for q in eps:
        scored = []
        for c in eps:
            if c["closed_us"] is None or c["incident_id"] == q["incident_id"] or (as_of and not c["closed_us"] < q["signal_us"]):
                continue
            w = weights.get(tuple(sorted((q["incident_id"], c["incident_id"]))), 0.0)
            if set(q["services"]) and set(c["services"]):
                topo = (1.0 if set(q["services"]) & set(c["services"]) else 0.5 if set(q["near"]) & set(c["services"])
                        else 0.3 if set(q["clusters"]) & set(c["clusters"]) else 0.0)
            else:
                topo = 0.0
            s = (0.45 * max(0.0, min(1.0, _jac(q["tokens"], c["tokens"]) + w)) + 0.2 * _jac(q["symptoms"], c["symptoms"])
                 + 0.15 * _jac(q["profile"], c["profile"]) + 0.1 * _jac(q["graph"], c["graph_closed"]) + 0.1 * topo)
            same = q["service"] is not None and q["service"] == c["service"]
            scored.append((-(max(0.0, min(1.0, s)) + (0.2 if same else 0.0)), c["closed_us"], c["incident_id"], same, c["family"]))
        scored.sort()
        fams: dict = {}
        for x in scored:
            if x[3]:
                fams.setdefault(x[4], []).append(x)
        order = sorted(fams, key=lambda f: (fams[f][0][0], str(f)))
        turns = [fams[f][i] for i in range(len(scored)) for f in order if i < len(fams[f])]
        rest = [x for x in scored if not x[3]]
        out[q["incident_id"]] = [(round(-x[0], 6)) for x in (turns + rest)[:k]]
    return out


@pytest.mark.parametrize("as_of", [True, False])
@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("block", [7, 4096])
def test_find_similar_equals_brute_force(land, monkeypatch, as_of, weighted, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "ASKED", 5 if block == 7 else 2048)
    monkeypatch.setattr(topk, "SHELF", 2 if block == 7 else 64)
    monkeypatch.setattr(topk, "CELLS", 500 if block == 7 else 1 << 24)
    eps = land.episodes.withColumn("family", F.col("signal_event_id") % 3)
    rows = eps.collect()
    ids = sorted(r["incident_id"] for r in rows if r["closed_us"] is not None)
    weights = {tuple(sorted((ids[i], ids[i + 2]))): (-0.2 if i % 2 else 0.2) for i in range(0, len(ids) - 2)} if weighted else {}
    w = land.spark.createDataFrame([(a, b, v) for (a, b), v in weights.items()], "a string, b string, w double") if weighted else None
    found = similarity.find_similar(similarity.query_view(eps), similarity.past_view(eps), 5, as_of, w, lsh=None)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(round(r["score"], 6))
    want = {k: v for k, v in _brute(rows, 5, as_of, weights).items() if v}
    assert got == want


def test_copies_collapse_without_losing_results(land):
    """Many incidents with equal features: the first k by closing time are returned."""
    one = land.episodes.where("closed_us IS NOT NULL AND service IS NOT NULL").limit(1)
    copies = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn(
        "incident_id", F.concat(F.lit("C-"), F.lpad(F.col("n").cast("string"), 4, "0"))).withColumn(
        "closed_us", F.col("n").cast("bigint")).withColumn("signal_us", F.col("n").cast("bigint") - 1).drop("n")
    heads, members = similarity.classes(similarity.past_view(copies), 5)
    assert heads.count() == 1 and members.count() == 6
    found = similarity.find_similar(similarity.query_view(copies), similarity.past_view(copies), 5)
    last = sorted((r["rank"], r["incident_id"]) for r in found.where("query_id = 'C-0200'").collect())
    assert [i for _, i in last] == ["C-0001", "C-0002", "C-0003", "C-0004", "C-0005"]
    assert found.where("query_id = 'C-0003'").count() == 1


def test_lexical_top_k(land):
    eps = land.episodes
    rows = eps.collect()
    got: dict = {}
    for r in similarity.lexical_top_k(similarity.query_view(eps), similarity.past_view(eps), as_of=False).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = round(r["score"], 6)
    missed = 0
    for q in rows:
        best = sorted((round(_jac(q["tokens"], c["tokens"]), 6) for c in rows if c["closed_us"] is not None and c["incident_id"] != q["incident_id"]), reverse=True)
        best = [b for b in best if b >= 0.05][:5] if q["tokens"] else []
        have = [got.get(q["incident_id"], {}).get(i + 1) for i in range(len(best))]
        missed += have != best
    assert missed == 0


def test_most_pairs_of_unlike_incidents_are_never_compared():
    """Twenty kinds of incidents with tokens of their own: a query opens the shelves of its kind."""
    rng = random.Random(4)
    lists = [sorted(1000 * (i // 100) + t for t in rng.sample(range(60), 30)) for i in range(2000)]
    scoring = topk.Scoring({"tokens": 1.0})
    index = topk.PastIndex({"tokens": topk.Sets.of(lists)}, scoring, topk.np.zeros(2000, int))
    asked = [lists[i] for i in range(0, 2000, 20)]
    q, row, score = index.search({"tokens": topk.Sets.of(asked)}, topk.np.zeros(100), lambda rows: topk.np.ones((100, len(rows)), bool), 5)
    for i, a in enumerate(asked):
        best = sorted((_jac(a, c) for c in lists), reverse=True)[:5]
        assert sorted(score[q == i].tolist(), reverse=True)[:5] == pytest.approx(best)
    assert index.compared < 0.15 * 100 * 2000


def test_remediation_rules(spark):
    flags = spark.createDataFrame([("a", True, True, False, "s"), ("b", True, False, True, None), ("c", False, True, False, "s"), ("d", True, False, False, "s")],
                                  "query_id string, deploy boolean, high_latency boolean, error_log boolean, service string")
    got: dict = {}
    for r in sorted(remediation.fallback(flags).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["action"], r["target"], r["confidence"]))
    assert got == {"a": [("rollback", "s", 0.4), ("scale_up", "s", 0.35)], "b": [("rollback", "unknown", 0.4)], "c": [("scale_up", "s", 0.35)],
                   "d": [("alert", "s", 0.2)]}


def test_pair_weights_are_clipped(spark):
    m = spark.createDataFrame([("q", 1, "a"), ("q", 4, "z")], "query_id string, rank int, incident_id string")
    g = spark.createDataFrame([("q", i, i * 1000, True) for i in range(6)] + [("q", 9, 9000, False)], "incident_id string, seq bigint, us bigint, success boolean")
    rows = learning.pair_weights(learning.pair_updates(m, g)).collect()
    assert [(r["a"], r["b"], round(r["w"], 6)) for r in rows] == [("a", "q", 0.15)]


LOG = "tbl string, key string, col string, value string, version bigint, peer string, deleted boolean"


def test_replica_scenario(spark):
    """Concurrent changes of different columns both survive; a delete wins over older writes only."""
    log = spark.createDataFrame([
        ("users", "u1", "name", "Alice", 1, "A", False), ("users", "u1", "email", "alice@x.com", 1, "A", False),
        ("users", "u1", "name", "Alice Cooper", 5, "A", False), ("users", "u1", "email", "alice@ex.org", 5, "B", False),
        ("users", "u3", "email", "bob@x.com", 1, "B", False), ("users", "u2", "email", "bob@x.com", 2, "A", False),
        ("users", "u4", "email", "dead@x.com", 2, "A", False), ("users", "u4", "", None, 3, "C", True),
        ("users", "u5", "email", "back@x.com", 4, "A", False), ("users", "u5", "", None, 3, "C", True)], LOG)
    cells = replicas.merge_cells(log)
    got = {(r["key"], r["col"]): r["value"] for r in cells.collect()}
    assert got == {("u1", "name"): "Alice Cooper", ("u1", "email"): "alice@ex.org", ("u3", "email"): "bob@x.com",
                   ("u2", "email"): "bob@x.com", ("u5", "email"): "back@x.com"}
    assert [r["value"] for r in replicas.duplicates(cells).collect()] == ["bob@x.com"]
    assert replicas.duplicates(replicas.repair_unique(cells)).isEmpty()
    assert replicas.unique_winners(cells).where("value = 'bob@x.com'").first()["key"] == "u3"
    prints = {r["fingerprint"] for r in replicas.order_invariance(log, [1, 2, 3]).collect()}
    assert len(prints) == 1
    kids = spark.createDataFrame([("o1", "u4"), ("o2", "u1")], "id string, user_id string")
    live = replicas.live_keys(log)
    for policy in ("cascade", "tombstone", "orphan"):
        done = replicas.apply_policy(kids, live, policy)
        assert replicas.policy_holds(done, live, policy, F.col("id") == "o1").first()["ok"]
    assert not replicas.policy_holds(kids, live, "cascade", F.col("id") == "o1").first()["ok"]


def test_peers_converge_by_exchanging_what_they_lack(spark):
    random.seed(6)
    rows = [("users", f"u{random.randrange(9)}", random.choice(["name", "email"]), str(v), v, random.choice("ABCD"), v % 7 == 0) for v in range(60)]
    log = spark.createDataFrame(rows, LOG)
    held = log.withColumn("holder", F.col("peer"))

    def prints(links):
        got = replicas.exchange(held, spark.createDataFrame(links, "src string, dst string"))
        return got, {r["fingerprint"] for r in replicas.fingerprint(replicas.merge_cells(got, ("holder",)), ["holder"]).collect()}

    ring = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")]  # changes travel several links
    got, states = prints(ring)
    assert states == {replicas.fingerprint(replicas.merge_cells(log)).first()["fingerprint"]}
    assert got.count() == 4 * len(set(rows))  # everybody has every change once
    _, broken = prints(ring[:3])
    assert len(broken) > 1
    again = replicas.deltas(got, spark.createDataFrame(ring, "src string, dst string"))
    assert again.isEmpty()


def test_rank_value_is_the_indexed_one(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [5, 1, 9, 9, 3, 7, 2, 8, 4, 6]], "g string, v double")
    place = F.greatest(F.lit(0), F.floor(0.95 * F.col("n")) - 1) + 1
    assert evaluate.rank_value(df, ["g"], "v", place, "x").first()["x"] == 9.0


def test_vectors(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "idx bigint, x array<double>")
    q = spark.createDataFrame([(1, [0.2, 3.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "query_id bigint, q array<double>")
    assert {r["query_id"]: r["predicted"] for r in vectors.classify(q, p).collect()} == {1: 1, 2: 0, 3: 0}


def test_any_number_of_patterns(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 700)
    monkeypatch.setattr(topk, "ASKED", 40)
    monkeypatch.setattr(vectors, "CELLS", 5000)
    rng = topk.np.random.default_rng(2)
    p = rng.normal(size=(5000, 6)).round(1)
    p[3000] = p[17] = [1, 0, 0, 0, 0, 2]
    p = p[(p != 0).any(axis=1)]
    p /= topk.np.sqrt((p * p).sum(axis=1, keepdims=True))
    q = topk.np.r_[rng.normal(size=(150, 6)), p[17:18] * 3, topk.np.zeros((1, 6)), p[40:42]]
    book = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "idx bigint, x array<double>")
    asked = spark.createDataFrame([(i, x.tolist(), "kept") for i, x in enumerate(q)], "query_id bigint, q array<double>, idx string")
    got = {r["query_id"]: r["predicted"] for r in vectors.classify(asked, book).collect()}
    for i, x in enumerate(q):
        cos = [sum(a * b for a, b in zip(x, y, strict=True)) for y in p]
        assert abs(cos[got[i]] - max(cos)) < 1e-9, i
    assert got[150] == 17 and got[151] == 0
    assert {r["predicted"] for r in vectors.classify(asked, book.where("1 = 0")).collect()} == {None}


def test_numbers_continue_and_a_busy_second_is_split(spark, tmp_path):
    rows = [(i, 1000 if i % 3 else i) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint").repartition(6)
    numbered = SRC.with_event_ids(df, ["us", "event_id"], 7)
    got = numbered.collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["event_id"]: r["row_id"] for r in got} == {i: 7 + n for n, (i, _) in enumerate(want)}
    laid = cut(df.repartitionByRange(8, "us", "event_id").withColumn("part", F.spark_partition_id()))
    assert laid.where("us = 1000").select("part").distinct().count() > 1
    log, whole = SRC.EventLog(spark, f"{tmp_path}/log", ["us", "event_id"]), SRC.EventLog(spark, f"{tmp_path}/whole", ["us", "event_id"])
    late = df.where("us >= 1000")
    for batch, part in ((0, df.where("us IS NULL OR us < 1000")), (1, late), (1, late), (0, late)):
        log.append(part, batch)
    whole.append(df, 0)
    assert sorted(log.read().collect()) == sorted(whole.read().collect())
    late.withColumn("row_id", F.lit(1).cast("bigint")).write.parquet(f"{tmp_path}/log/rows/batch=2")  # stopped before its marker
    assert log.read().count() == 3001


def test_landed_events_are_skipped(land):
    """Kinds prune folders, other filters reach the scan, and only asked columns are read."""
    plan = land.events.where("kind = 'deploy' AND event_id = 17").select("service")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "EqualTo(event_id,17)" in plan and "ReadSchema: struct<event_id:bigint,service:string>" in plan


def test_context_has_one_row_per_signal(land):
    rows = land.context.collect()
    assert sorted(r["incident_id"] for r in rows) == sorted(r["incident_id"] for r in land.sigs.collect())
    for r in rows:
        stamps = [e["cause_ts"] for e in r["causal_chain"]]
        assert stamps == sorted(stamps) and len(r["causal_chain"]) <= 5
        assert len(r["similar_past_incidents"]) <= 5 and 1 <= len(r["suggested_remediations"]) <= 3
        assert len(r["related_events"]) <= 30 and r["explain"].startswith(f"{r['incident_id']}: ")


def _items_by_pairs(sigs, facts, before, after):
    """Every signal with every fact in its window."""
    want: dict = {}
    for inc, sid, us, sec, affected, own in sigs:
        def role(of, to):
            return "unknown" if of is None or to is None else "self" if of == to else "peer"

        def hit(edges, first, last):
            out = []
            for label, lo, hi, lo_in, hi_in in edges:
                above = lo is None or (last - us >= lo * 10**6 if lo_in else last - us > lo * 10**6)
                below = hi is None or (first - us <= hi * 10**6 if hi_in else first - us < hi * 10**6)
                if above and below:
                    out.append(label)
            return out

        for fsec, cls, item, who, signal, first, last, n in facts:
            if not sec - before <= fsec <= sec + after:
                continue
            tokens = [f":{b}" for b in hit(features.token_buckets(before, after), first, last)]
            made = {
                "r": [f"t|{item}:{role(who, affected)}{b}" for b in tokens], "p": [f"t|{item}{b}" for b in tokens],
                "s": [f"t|{item}{b}" for b in tokens if role(who, affected) == "self"], "y": [f"y|{item}"],
                "k": [f"k|{item}:{b}" for b in hit(features.PROFILE_BUCKETS, first, last) if signal is None or signal != sid],
                "v": [f"v|{who}"], "g": [f"g|{item}:{role(who, own)}"], "f": [f"f|{item}"]}[cls]
            for x in made:
                want[inc, x] = want.get((inc, x), 0) + n
    return want


@pytest.mark.parametrize(("before", "after", "split"), [(2400, 60, 10**6), (700, 45, 40)])
def test_items_of_incidents_match_all_pairs(spark, before, after, split):
    """Times on bucket edges, names that are missing, a stretch split by item and by incident; no pair is formed."""
    random.seed(17)

    def named(cls):  # classes share no items, and a service that takes part has none
        return "" if cls == "v" else cls + random.choice("xyz")

    edges = [0, 30, 180, 900, 2400, -60, -120, 60, 300, 700]
    sigs, facts = [], []
    for i in range(60):
        us = random.randrange(40_000 * 10**6)
        sigs.append((f"i{i}", 10_000 + i, us, us // 10**6, random.choice(["a", "b", None]), random.choice(["a", "c", None])))
        for _ in range(6):
            at = max(0, us - random.choice(edges) * 10**6 + random.choice([-1, 0, 1]))
            cls = random.choice("rskvg")
            facts.append((at // 10**6, cls, named(cls), random.choice(["a", "b"]), None, at, at, random.randrange(1, 4)))
        facts.append((us // 10**6, "k", "incident_signal", None, 10_000 + i, us, us, 1))
    for _ in range(300):
        first = random.randrange(40_000 * 10**6)
        last = random.randrange(first, (first // 10**6 + 1) * 10**6)
        cls = random.choice("rrpskyvgf")
        who = random.choice(["a", "b", "c"] if cls == "v" else ["a", "b", "c", None])
        facts.append((first // 10**6, cls, named(cls), who, None, first, last, random.randrange(1, 4)))
    s = spark.createDataFrame(sigs, "incident_id string, signal_event_id bigint, signal_us bigint, signal_sec bigint, affected_id string, own_id string")
    f = spark.createDataFrame(facts, "sec bigint, cls string, item string, identity_id string, signal_id bigint, min_us bigint, max_us bigint, n bigint")
    got = features.incident_items(s, f, before, after, facts_per_task=split, signals_per_task=split)
    assert {(r["incident_id"], x["item"]): x["n"] for r in got.collect() for x in r["items"]} == _items_by_pairs(sigs, facts, before, after)


def test_blocks_of_a_large_search_grow(spark, monkeypatch):
    """Rows are sent to every block of the other side: few large ones, not many small ones."""
    for name, value in (("BLOCK", 4), ("ASKED", 4), ("SPREAD", 3), ("LARGEST", 50)):
        monkeypatch.setattr(topk, name, value, raising=False)
    past = spark.range(200).select(F.col("id").alias("class_id"), F.lit("").alias("scope"))
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.lit("").alias("q_scope"))
    of_past, of_asked = topk.dealt(past, asked, ["scope"], "class_id", "query_id")
    assert sum(r["count"] for r in of_past.count().collect()) == 200 * 3
    assert sum(r["count"] for r in of_asked.count().collect()) == 100 * 4


@pytest.mark.parametrize("times", [1000, 3, 1])
def test_blocks_of_a_search_are_stretches_of_time(spark, monkeypatch, times):
    """Past rows meet every query after them once; rows that are too late for a block are not sent there."""
    for name, value in (("BLOCK", 4), ("ASKED", 4), ("SPREAD", 6), ("LARGEST", 20)):
        monkeypatch.setattr(topk, name, value)
    past = spark.range(200).select(F.col("id").alias("class_id"), (F.col("id") * 7919 % times).alias("closed_us"), F.lit("").alias("scope"))
    asked = spark.range(100).select(F.col("id").alias("query_id"), (F.col("id") * 104_729 % times).alias("q_us"), F.lit("").alias("q_scope"))
    of_past, of_asked = topk.dealt(past, asked, ["scope"], "class_id", "query_id", "closed_us", "q_us")

    def pairs(left, right):
        both = left.merge(right, how="cross")
        return both[both["closed_us"] < both["q_us"]][["class_id", "query_id"]]

    got = [(r["class_id"], r["query_id"]) for r in of_past.cogroup(of_asked).applyInPandas(pairs, "class_id long, query_id long").collect()]
    want = [(a, b) for a in range(200) for b in range(100) if a * 7919 % times < b * 104_729 % times]
    assert sorted(got) == want
    sent = sum(r["count"] for r in of_past.count().collect())
    assert sent < 200 * 10 * (0.7 if times == 1000 else 1.01)


def test_components_are_found_without_joins(spark, monkeypatch):
    """A round plans few stages: the driver of many rounds keeps little."""
    plans, real = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200}
    assert plans and not any("Join" in p for p in plans)


def test_templates_are_summarised_without_sorting(spark, monkeypatch):
    """Shapes alone in their group, several that agree, several that do not; tokens of all places are never sorted."""
    plans, real = [], templates.cut
    monkeypatch.setattr(templates, "cut", lambda df: (plans.append(df._jdf.queryExecution().toString()), real(df))[1])
    shapes = ["up a b c", "up a b d", "up a x y z", "down now", "w q e r t", "w q e r u", "w k l m n", "one"]
    rows = spark.createDataFrame([(x, len(x.split()), 1, i, i) for i, x in enumerate(shapes)], "shape string, n_tokens int, freq bigint, first_seen bigint, last_seen bigint")
    got = {r["shape"]: r["pattern"] for r in templates.cluster(rows).collect()}
    assert got == {"up a b c": "up a b <*>", "up a b d": "up a b <*>", "up a x y z": "up a x y z", "down now": "down now", "w q e r t": "w q e r <*>",
                   "w q e r u": "w q e r <*>", "w k l m n": "w k l m n", "one": "one"}
    assert plans and not any("SortAggregate" in p for p in plans)


def test_pairs_of_an_interval_join_are_spread(spark, monkeypatch):
    """Few rows that make many pairs: no task makes most of them, nor when all stand in one bin."""
    monkeypatch.setattr(windows, "PAIRS_OF_TASK", 2000, raising=False)
    monkeypatch.setattr(windows, "PAIRS_OF_BIN", 5000, raising=False)
    for seconds in (20_000, 50):
        s = spark.range(200).select(F.concat(F.lit("i"), "id").alias("incident_id"), (F.col("id") * 7919 % seconds).alias("signal_sec"))
        e = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") * 104_729 % seconds).alias("sec"))
        got = windows.interval_join(s, e, "event_id", 2400, 60)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == sum(a * 7919 % seconds - 2400 <= b * 104_729 % seconds <= a * 7919 % seconds + 60 for a in range(200) for b in range(1000))
        assert max(sizes) < sum(sizes) / 4


def test_checkpoints_hand_no_guessed_sizes_on(spark):
    """Guesses of joined tables that are cut again and again would grow until the driver only multiplies them."""
    df = cut(spark.range(20).select("id", (F.col("id") % 4).alias("k")))
    for _ in range(4):
        df = cut(df.join(df.withColumnRenamed("id", "other"), "k").groupBy("k").agg(F.max("other").alias("id")))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert sorted((r["k"], r["id"]) for r in df.collect()) == [(k, 16 + k) for k in range(4)]


def test_templates_of_whole_lines(spark, land):
    """Lines far longer than 512 characters: what stands behind them counts, and groups are tried by as many first tokens as it takes."""
    same, rest = [f"w{'x' * (i % 7)}y" for i in range(600)], ["u", "v"]
    lines = [" ".join(same + [r] * 600) for r in rest] + [" ".join(same[:-1] + [r] * 601) for r in ("k", "l")] + ["a b 7"]
    logs = spark.createDataFrame(list(enumerate(lines)), "us long, msg string")
    found = templates.cluster(templates.shapes(logs, chars=None))
    got = {r["first_seen"]: r["pattern"] for r in found.collect()}
    # All four agree on 599 of 1,200 places, which is less than half of them; by their first 512 tokens they still stand together.
    alone = " ".join(same[:-1])
    assert got[0] == got[1] == " ".join(same + ["<*>"] * 600) and got[4] == "a b <*>"
    assert got[2] == lines[2] and got[3] == lines[3] and alone in got[2]
    told = templates.assign(logs.withColumnRenamed("us", "line_id"), found, chars=None)
    assert told.where("template_id IS NULL").count() == 0
    # The query: every token of every line, longer ones included, is in its template or a parameter.
    long = land.table("documents").select(F.explode(F.split("text", "\n")).alias("msg")).where("length(msg) > 600")
    assert long.count() > 0
    kept = land.line_templates.agg(F.max("n_tokens")).first()[0]
    assert kept == land.table("documents").select(F.explode(F.split("text", "\n")).alias("msg")).agg(
        F.max(F.size(F.regexp_extract_all("msg", F.lit(r"[A-Za-z0-9_\.\-/:]+"), F.lit(0))))).first()[0]


def test_signatures_by_distinct_tokens(spark):
    """The same least hashes as column functions find, as text and as numbers."""
    rnd = random.Random(6)
    rows = [(f"i{n}", [f"t{x}é" for x in rnd.sample(range(60), rnd.randrange(0, 12))]) for n in range(80)]
    df = spark.createDataFrame(rows, "incident_id string, tokens array<string>")
    want = {r["incident_id"]: r["s"] for r in df.where(F.size("tokens") > 0).select("incident_id", sets.md5_minhash(F.col("tokens"), 16).alias("s")).collect()}
    got = {r["incident_id"]: r["signature"] for r in sets.md5_signatures(df, 16, text=True).collect()}
    assert got == {k: ",".join(v) for k, v in want.items()} and len(got) < 80
    numbers = {r["incident_id"]: r["signature"] for r in sets.md5_signatures(df, 16).collect()}
    assert all((x == y) == (numbers[a][p] == numbers[b][p]) for a in want for b in want for p, (x, y) in enumerate(zip(want[a], want[b], strict=True)))


@pytest.mark.parametrize("common", [1, 5, 1000])
def test_agreeing_rows_are_counted_without_pairs(spark, monkeypatch, common):
    """Hashes as bitmaps and as lists of rows, in several blocks, against all pairs."""
    monkeypatch.setattr(similarity, "COMMON", common)
    monkeypatch.setattr(similarity, "AT_ONCE", 7)
    rnd = random.Random(8)
    known = [(f"c{n}", rnd.randrange(50) if rnd.random() < 0.9 else None, [rnd.randrange(4) + 10 * b if rnd.random() < 0.5 else rnd.randrange(1000, 9000) * 10 + b for b in range(3)]) for n in range(300)]
    asked = [(f"q{n}", rnd.randrange(60) if rnd.random() < 0.9 else None, [rnd.randrange(5) + 10 * b for b in range(3)]) for n in range(120)]
    monkeypatch.setattr(topk, "BLOCK", 40)
    got = {r["query_id"]: r["n"] for r in similarity._agreeing(
        spark.createDataFrame(asked, "query_id string, q_us long, _qb array<long>"), spark.createDataFrame(known, "class_id string, closed_us long, _cb array<long>")).collect()}
    want = {q: sum(t is not None and t < us and bool(set(h) & set(g)) for _, t, h in known) for q, us, g in asked if us is not None}
    assert got == {q: n for q, n in want.items() if n}
    left, right = (similarity.pd.DataFrame(x, columns=c) for x, c in ((known, ["class_id", "closed_us", "_cb"]), (asked, ["query_id", "q_us", "_qb"])))
    one = similarity._count_agreeing(left.dropna(), right.dropna())
    assert dict(zip(one["query_id"], one["n"], strict=True)) == got


def test_candidates_are_moved_as_hashes(land):
    """What is moved once for every pair has no words; what pairs share is told in words."""
    from opsrecall.plans import catalog
    hashed, told = catalog._candidates(land), catalog._candidates(land, ("tokens",))
    assert {hashed.schema[c].dataType.simpleString() for c in ("tokens", "q_tokens", "q_near", "graph")} == {"array<bigint>"}
    words = {r["incident_id"]: set(r["tokens"]) for r in land.episodes.collect()}
    rows = told.collect()
    assert rows and all(set(r["tokens"]) == words[r["query_id"]] & words[r["incident_id"]] for r in rows)


def test_blocks_of_a_search_are_not_shuffled(spark, land, monkeypatch):
    """A block is written once and read by pairs of partitions, however many blocks it meets; one that is too late is not searched."""
    for name, value in (("BLOCK", 20), ("ASKED", 10), ("SPREAD", 6), ("LARGEST", 40)):
        monkeypatch.setattr(topk, name, value)
    past = spark.range(200).select(F.col("id").alias("class_id"), (F.col("id") * 10).alias("closed_us"), F.lit("").alias("scope"))
    asked = spark.range(100).select(F.col("id").alias("query_id"), (F.col("id") * 20).alias("q_us"), F.lit("").alias("q_scope"))

    def pairs(left, right):
        both = left.merge(right, how="cross")
        return both[both["closed_us"] < both["q_us"]].assign(met=len(both))[["class_id", "query_id", "met"]]

    got = topk.met_blocks(past, asked, "class_id", "query_id", "closed_us", "q_us", pairs, "class_id long, query_id long, met long")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = got.collect()
    assert sorted((r["class_id"], r["query_id"]) for r in rows) == [(a, b) for a in range(200) for b in range(100) if a * 10 < b * 20]
    assert max(r["met"] for r in rows) < 60 * 40


def test_ties_of_a_search_go_by_incident(spark, land):
    """Equal scores and closing times: the first incidents by id are kept, not those whose features hash low."""
    base = land.episodes.where("closed_us IS NOT NULL").orderBy("incident_id").limit(1).drop("incident_id", "signal_us", "closed_us", "tokens")
    rows = [(f"P{i:02}", 5, 10, [f"t{i}"]) for i in range(12)] + [("Q", 100, 200, ["x"])]
    eps = cut(base.crossJoin(spark.createDataFrame(rows, "incident_id string, signal_us long, closed_us long, tokens array<string>")))
    got = similarity.find_similar(similarity.query_view(eps), similarity.past_view(eps), 5).where("query_id = 'Q'").orderBy("rank").collect()
    assert [r["incident_id"] for r in got] == [f"P{i:02}" for i in range(5)]


def test_search_is_the_same_in_many_small_blocks(spark, land, monkeypatch):
    """Tasks that read several past blocks and drop what is of no use lose nothing."""
    def found():
        got = similarity.find_similar(similarity.query_view(land.episodes), similarity.past_view(land.episodes), 3)
        return sorted((r["query_id"], r["rank"], r["incident_id"], r["score"]) for r in got.collect())

    want = found()
    for name, value in (("BLOCK", 6), ("ASKED", 7), ("SPREAD", 2), ("LARGEST", 8), ("KEPT_ROWS", 5)):
        monkeypatch.setattr(topk, name, value)
    assert found() == want and want
