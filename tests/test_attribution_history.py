"""Attribution, outside conclusions, similarity and comparison on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import attribution as AT
from pulseframe.operators import clusters as CL
from pulseframe.operators import evaluate as EV
from pulseframe.operators import history as H
from pulseframe.operators import similarity as S_
from pulseframe.operators.skew import split_keys
from pulseframe.session import literal_table
from tests.test_groups_scores import active, topo

S, L = "string", "long"
BANK, ORDER, GATE = "bank-channel", "order-svc", "gateway"


def build(spark, *items):
    svc, w, c = topo(spark)
    g = CL.assign(active(spark, *items), c, svc)
    cl = CL.clusters(g, c, w)
    return svc, cl, CL.members(g, cl)


def changes(spark, *items):
    """items: (id, service, minutes after the epoch minute 1_000_000 s)."""
    df = literal_table(spark, [("run_id", S), ("change_id", S), ("service", S), ("t", L), ("type", S)],
                       [("r1", i, s, 1_000_000 + m * 60, "release") for i, s, m in items])
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def category(spark, *items, chg=()):
    svc, cl, _ = build(spark, *items)
    return AT.attribute(cl, changes(spark, *chg) if chg else changes(spark, ("none", "nowhere", 0)), svc).first()


def test_decision_order(spark):
    cpu = ("RES-01", ORDER, "order-svc-0", "cpu_usage", 1, 20)
    assert category(spark, cpu).category == "resource_bottleneck"
    assert category(spark, cpu, chg=[("c1", ORDER, 5), ("c2", ORDER, 12), ("c3", ORDER, 25)]).change_id == "c2"
    assert category(spark, cpu, chg=[("old", ORDER, -20)]).category == "resource_bottleneck"
    assert category(spark, ("BIZ-04", GATE, "gateway-0", "qps", 2)).category == "traffic_fluctuation"
    assert category(spark, ("RES-03", ORDER, "order-svc-0", "mem_usage", 1)).category == "code_defect"
    assert category(spark, ("RES-05", ORDER, "order-svc-0", "cpu_usage", 2)).category == "capacity_config"
    assert category(spark, ("PERF-03", ORDER, "order-svc-0", "latency_p99", 2)).category == "resource_bottleneck"
    unknown = category(spark, ("BIZ-01", ORDER, "order-svc-0", "success_rate", 2))
    assert (unknown.category, unknown.confidence) == ("unknown", 0.25)


def test_full_pool_blames_downstream_only_if_affected(spark):
    conn = ("RES-04", ORDER, "order-svc-0", "conn_usage", 1)
    slow = ("PERF-01", ORDER, "order-svc-0", "latency_p99", 2)
    assert category(spark, conn, slow, ("PERF-01", BANK, "bank-channel-0", "latency_p99", 2)).category == "dependency_failure"
    assert category(spark, conn, slow).category == "resource_bottleneck"


def test_traffic_with_exhausted_instances_adds_advice(spark):
    r = category(spark, ("BIZ-03", GATE, "gateway-0", "qps", 2), ("RES-01", ORDER, "order-svc-0", "cpu_usage", 1))
    assert len(r.suggestions) == 4 and any("30%" in s for s in r.suggestions)


def test_guard_backfill_and_recurrence(spark):
    svc, cl, m = build(spark, ("RES-01", ORDER, "order-svc-0", "cpu_usage", 1), ("RES-01", "stranger", "s-0", "cpu_usage", 3))
    prop = literal_table(
        spark, [("run_id", S), ("cluster_id", S), ("category", S), ("root_cause_service", S), ("confidence", "double"), ("evidence_ids", "array<string>")],
        [("r1", "CLUS-01", "ghosts", "mars", 0.9, ["made-up"]), ("r1", "CLUS-77", "unknown", None, 0.5, ["x"])])
    g, = AT.guard(prop, cl, CL.evidence(m)).collect()
    assert (g.category, g.root_cause_service, g.confidence, g.evidence_ids) == ("unknown", None, 0.4, [])
    assert g.repairs == ["category", "evidence", "confidence", "service"]
    own = AT.attribute(cl, changes(spark, ("none", "nowhere", 0)), svc)
    full = {r.cluster_id: r.source for r in AT.backfill(AT.guard(prop, cl, CL.evidence(m)), own).collect()}
    assert full == {"CLUS-01": "outside", "CLUS-02": "rules"}


def sig(spark, *items):
    return literal_table(spark, [("run_id", S), ("cluster_id", S), ("signature", S)], list(items))


def windows(spark, *items):
    return literal_table(spark, [("run_id", S), ("t", L)], list(items)).select("run_id", F.timestamp_seconds("t").alias("window_end"))


def test_jaccard_values_and_scope(spark):
    cur = sig(spark, ("now", "c", "a&b"))
    hist = sig(spark, ("r1", "x", "a&b"), ("r2", "x", "b&c"), ("r3", "x", "c&d"), ("same", "x", "a&b"))
    w = windows(spark, ("now", 100), ("r1", 10), ("r2", 20), ("r3", 30), ("same", 100))
    m = {r.match_run: r.similarity for r in H.jaccard_matches(cur, hist, w, k=3).collect()}
    assert m == {"r1": 1.0, "r2": pytest.approx(1 / 3)}
    assert H.recurrence(cur, H.jaccard_matches(cur, hist, w, k=None)).first().is_recurring
    only_same = H.jaccard_matches(cur, hist.where("run_id = 'same'"), w, k=3)
    assert not H.recurrence(cur, only_same).first().is_recurring


def test_jaccard_matches_brute_force_with_a_hot_token(spark):
    items = [(f"r{i}", "c", "&".join(["hot"] + [f"t{j}" for j in range(5) if (i * 7 + j * 3) % 4 == 0])) for i in range(40)]
    w = windows(spark, *[(f"r{i}", i) for i in range(40)])
    got = {(r.run_id, r.match_run): r.similarity for r in H.jaccard_matches(sig(spark, *items), sig(spark, *items), w, k=None).collect()}
    want = {}
    for i, (a, _, sa) in enumerate(items):
        for j, (b, _, sb) in enumerate(items):
            x, y = set(sa.split("&")), set(sb.split("&"))
            if j < i and x & y:
                want[(a, b)] = len(x & y) / len(x | y)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_similar_sets_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = {f"s{i:03d}": frozenset(rng.sample("abcdefghijkl", rng.randint(0, 6))) | ({"hot"} if rng.random() < 0.6 else set()) for i in range(120)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, tokens array<string>")
    got = {(r.a, r.b): r.similarity for r in S_.similar_sets(df, threshold).collect()}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and x and y and len(x & y) / len(x | y) >= threshold}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("earlier", [True, False])
def test_recurring_equals_the_best_of_all_matches(spark, earlier):
    rng = random.Random(7)
    items = [(f"r{i}", f"c{j}", "&".join(rng.sample("abcdefg", rng.randint(1, 5)) + (["a"] if j else []))) for i in range(12) for j in range(3)]
    items += [("r3", "none", ""), ("r5", "null", None), ("ghost", "c", "a&b")]
    w = windows(spark, *[(f"r{i}", i // 2) for i in range(12)])
    cur = sig(spark, *items)
    want = H.recurrence(cur, H.jaccard_matches(cur, cur, w, k=None, earlier_only=earlier))
    got = S_.recurring(cur, cur, w, 0.6, earlier_only=earlier)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("is_recurring").count() > 3


def test_split_keys(spark):
    left = spark.range(3).select(F.col("id").alias("k"), F.lit("l").alias("v"))
    right = spark.range(100).select(F.when(F.col("id") < 90, 0).otherwise(5).cast("long").alias("k"), F.col("id").alias("w"))
    a, b = split_keys(left, right, ["k"], ["w"], rows=10)
    assert a.where("k = 0").count() == 9 and a.where("k > 0").count() == 0
    assert sorted(r.w for r in a.join(b, ["k", "_part"]).collect()) == list(range(90))


def test_run_diff_and_trend(spark):
    a = literal_table(spark, [("run_id", S), ("anomaly_id", S), ("is_suppressed", "boolean")],
                      [("p", "x", False), ("p", "y", False), ("q", "y", False), ("q", "z", True)])
    r = literal_table(spark, [("run_id", S), ("scenario_id", S), ("started_at", L)], [("p", "A", 1), ("q", "B", 2)])
    pairs = H.previous_run(r)
    assert {(x.anomaly_id, x.state) for x in H.run_diff(a, pairs).collect()} == {("x", "recovered"), ("y", "persistent"), ("z", "new")}
    assert {(x.anomaly_id, x.state) for x in H.run_diff(a, pairs, include_suppressed=False).collect()} == {("x", "recovered"), ("y", "persistent")}
    sets = {k: [x[0] for x in v.collect()] for k, v in H.diff_sets(a, "q", "p").items()}
    assert sets == {"new": ["z"], "recovered": ["x"], "persistent": ["y"]}
    s = literal_table(spark, [("run_id", S), ("total", "double")], [("p", 80.0), ("q", 79.0)])
    assert H.score_trend(r, s).first().trend == "flat"
    assert H.previous_run(r, per_scenario=True).where("prev_run_id IS NOT NULL").count() == 0


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_over_range_borders(spark, many_ranges):
    """Ranges without a change of their own take the last one before them; ties go to the smallest id."""
    rng = random.Random(3)
    ch = [(f"c{i:02d}", rng.choice("ab"), rng.randint(0, 8000) // 60 * 60, "x") for i in range(25)] + [("null", None, 5, "x"), ("never", "a", None, "x")]
    on = [(i, rng.choice("abz"), rng.randint(0, 9000)) for i in range(300)] + [(900, "a", None), (901, None, 50)]
    got = {r.k: (r.change_id, r.minutes_before) for r in AT.asof_change(
        spark.createDataFrame(on, "k long, service string, t long").select("k", "service", F.timestamp_seconds("t").alias("onset")),
        spark.createDataFrame(ch, "change_id string, service string, t long, type string").select("change_id", "service", F.timestamp_seconds("t").alias("ts"), "type"),
        ["k"]).collect()}
    want = {}
    for k, s, t in on:
        near = [(t - u, c) for c, v, u, _ in ch if None not in (t, s, u) and v == s and 0 <= t - u <= 1800]
        if near:
            want[k] = (min(near)[1], min(near)[0] / 60)
    assert got == want and len(got) > 100


def test_asof_edges_and_hot_service(spark):
    on = literal_table(spark, [("k", L), ("service", S), ("t", L)], [(i, "hot", 10_000 + i * 600) for i in range(20)]).select(
        "k", "service", F.timestamp_seconds("t").alias("onset"))
    ch = literal_table(spark, [("change_id", S), ("service", S), ("t", L), ("type", S)],
                       [(f"c{i:03d}", "hot", 8_200 + i * 37, "config") for i in range(300)]).select(
        "change_id", "service", F.timestamp_seconds("t").alias("ts"), "type")
    got = {r.k: r.change_id for r in AT.asof_change(on, ch, ["k"]).collect()}
    want = {}
    for k in range(20):
        onset = 10_000 + k * 600
        near = [(onset - (8_200 + i * 37), f"c{i:03d}") for i in range(300) if 0 <= onset - (8_200 + i * 37) <= 1800]
        if near:
            want[k] = min(near)[1]
    assert got == want


def test_evaluation_rates(spark):
    lab = literal_table(spark, [("run_id", S), ("expected_causes", "array<string>"), ("expected_level", "int"), ("expect_clean", "boolean")],
                        [("a", ["x"], 1, False), ("b", ["x"], 1, False), ("c", ["none"], 0, True), ("d", ["x"], 1, False)])
    res = literal_table(spark, [("run_id", S), ("causes", "array<string>"), ("top_level", "int"), ("p1", L), ("p2", L), ("degraded", "boolean"), ("error", S)],
                        [("a", ["x", "y"], 1, 1, 0, False, None), ("b", ["y"], 2, 0, 1, True, None), ("c", ["y"], 4, 0, 0, False, None), ("d", None, None, None, None, None, "boom")])
    s = EV.summary(EV.outcomes(lab, res)).first()
    assert (s.graded, s.cause_accuracy, s.level_accuracy, s.false_positive_rate) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3), 0.0)
    assert s.degraded_ratio == pytest.approx(1 / 3)
