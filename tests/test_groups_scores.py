"""Merging, suppression, clusters, rollups and scores on hand-made anomalies."""

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import anomalies as A
from pulseframe.operators import clusters as CL
from pulseframe.operators import graph as G
from pulseframe.operators import rollups as RU
from pulseframe.operators import score as S
from pulseframe.policy import Policy, Service
from pulseframe.session import literal_table

TOPO = [
    Service("gateway", ["gateway-0", "gateway-1"], ["order-svc"], "trade", criticality=1.0),
    Service("order-svc", ["order-svc-0", "order-svc-1"], ["bank-channel"], "trade", criticality=1.0),
    Service("bank-channel", ["bank-channel-0"], [], "external", external=True, criticality=0.5),
]
POL = Policy(services=TOPO)
DIM = {"B": "business", "P": "performance", "R": "resource"}


def findings(spark, *items):
    """items: (rule, service, instance, metric, level[, first minute[, observed[, amplitude[, duration]]]])."""
    data = []
    for it in items:
        rule, svc, inst, metric, level, *rest = it
        first, obs, amp, dur = (list(rest) + [0, 90.0, 0.8, 10.0][len(rest):])[:4]
        dim = "link" if rule == "BIZ-06" else DIM[rule[0]]
        data.append(("r1", rule, dim, svc, inst, metric, level, float(obs), 99.0, -5.0, -9.0, float(amp), 1.0, float(dur), 0.5,
                     1_000_000 + first * 60, 1_003_600, "dynamic", "high", "text"))
    cols = [("run_id", "string"), ("rule_id", "string"), ("dimension", "string"), ("service", "string"), ("instance", "string"),
            ("metric", "string"), ("level", "int"), ("observed", "double"), ("baseline_value", "double"), ("deviation_pct", "double"),
            ("z_score", "double"), ("amplitude", "double"), ("affected_ratio", "double"), ("duration_min", "double"),
            ("deviation_score", "double"), ("f", "long"), ("l", "long"), ("baseline_mode", "string"), ("baseline_confidence", "string"), ("reason", "string")]
    df = literal_table(spark, cols, data)
    return df.withColumn("first_seen", F.timestamp_seconds("f")).withColumn("last_seen", F.timestamp_seconds("l")).drop("f", "l").withColumn(
        "evidence", F.create_map(F.lit("owner"), F.lit("x")))


def active(spark, *items, policy=POL):
    return A.aggregate(findings(spark, *items), policy.service_dim(spark)).where("NOT is_suppressed")


def topo(spark, policy=POL):
    svc = policy.service_dim(spark)
    e = G.edges(svc)
    w = G.walks(e, svc.select(F.col("service").alias("node")))
    return svc, w, G.walk_closure(w)


def clustered(spark, *items, policy=POL, **kw):
    svc, w, c = topo(spark, policy)
    g = CL.assign(active(spark, *items, policy=policy), c, svc, **kw)
    return CL.clusters(g, c, w).orderBy("rank").collect()


def runs(spark, *ids):
    return literal_table(spark, [("run_id", "string")], [(i,) for i in (ids or ("r1",))])


def test_merge_keeps_the_worst_and_widens(spark):
    f = findings(spark, ("RES-01", "gateway", "gateway-0", "cpu_usage", 2, 5, 91.0, 0.6, 4.0), ("RES-01", "gateway", "gateway-0", "cpu_usage", 3, 1, 88.0, 0.9, 9.0))
    r, = A.merge_findings(f).collect()
    assert (r.level, r.merged_count, r.amplitude, r.duration_min) == (2, 2, 0.9, 9.0)
    assert r.first_seen.minute == (1_000_060 // 60) % 60


def test_suppression_only_strictly_milder(spark):
    a = A.aggregate(findings(spark, ("RES-01", "gateway", "gateway-0", "cpu_usage", 1), ("RES-05", "gateway", "gateway-0", "cpu_usage", 3),
                             ("RES-02", "gateway", "gateway-0", "mem_usage", 3)), POL.service_dim(spark))
    got = {r.rule_id: r for r in a.collect()}
    assert got["RES-05"].is_suppressed and got["RES-05"].suppressed_by == "RES-01|gateway|gateway-0|cpu_usage"
    assert not got["RES-01"].is_suppressed and not got["RES-02"].is_suppressed


def test_blast_radius_counts_declared_instances(spark):
    a = A.aggregate(findings(spark, ("RES-01", "gateway", "gateway-0", "cpu_usage", 2), ("RES-01", "gateway", "gateway-1", "cpu_usage", 2),
                             ("RES-02", "order-svc", "order-svc-0", "mem_usage", 2)), POL.service_dim(spark))
    assert {r.rule_id: r.affected_ratio for r in a.collect()} == {"RES-01": 1.0, "RES-02": 0.5}


def test_downstream_bottleneck_is_the_root(spark):
    c, = clustered(spark, ("PERF-01", "gateway", "gateway-0", "latency_p99", 1, 3), ("PERF-01", "order-svc", "order-svc-0", "latency_p99", 1, 2),
                   ("PERF-01", "bank-channel", "bank-channel-0", "latency_p99", 1, 0))
    assert c.primary.service == "bank-channel" and c.hypothesis == "propagating"
    assert c.path == ["gateway", "order-svc", "bank-channel"] and c.upstream == ["gateway", "order-svc"]


def test_traffic_points_to_the_entry(spark):
    c, = clustered(spark, *[("BIZ-04", s.name, s.instances[0], "qps", 2) for s in TOPO], ("RES-01", "order-svc", "order-svc-0", "cpu_usage", 1))
    assert c.primary.rule_id == "BIZ-04" and c.primary.service == "gateway"
    c, = clustered(spark, *[("BIZ-04", s.name, s.instances[0], "qps", 2) for s in TOPO])
    assert c.hypothesis == "traffic"


def test_level_beats_direction_and_chain_is_never_root(spark):
    c, = clustered(spark, ("BIZ-01", "gateway", "gateway-0", "success_rate", 4), ("BIZ-02", "order-svc", "order-svc-0", "business_error_rate", 2),
                   ("BIZ-06", "gateway", "bank-channel", "success_rate", 1))
    assert c.primary.rule_id == "BIZ-02" and c.max_level == 1


def test_signature_ignores_order_and_instances(spark):
    a = ("RES-01", "gateway", "gateway-0", "cpu_usage", 2)
    b = ("RES-01", "gateway", "gateway-1", "cpu_usage", 2)
    x = ("RES-02", "order-svc", "order-svc-0", "mem_usage", 2)
    assert clustered(spark, a, b, x)[0].signature == clustered(spark, x, a)[0].signature == "gateway.cpu_usage&order-svc.mem_usage"


def test_off_topology_stays_single_and_induced_splits(spark):
    items = [("RES-01", "gateway", "gateway-0", "cpu_usage", 2), ("RES-01", "bank-channel", "bank-channel-0", "cpu_usage", 1),
             ("RES-01", "stranger", "s-0", "cpu_usage", 3), ("RES-02", "stranger", "s-0", "mem_usage", 3)]
    got = clustered(spark, *items)
    assert [c.size for c in got] == [2, 1, 1] and got[0].cluster_id == "CLUS-01"
    assert [c.size for c in clustered(spark, *items, induced=True)] == [1, 1, 1, 1]


def test_rollups_agree_and_healthy_services_stay(spark):
    svc, w, c = topo(spark)
    act = active(spark, ("BIZ-06", "gateway", "bank-channel", "success_rate", 1), ("RES-01", "order-svc", "order-svc-0", "cpu_usage", 2),
                 ("RES-02", "order-svc", "order-svc-0", "mem_usage", 3))
    cl = CL.clusters(CL.assign(act, c, svc), c, w)
    st = RU.service_stats(act, cl, runs(spark), svc)
    got = {r.service: r for r in st.collect()}
    assert set(got) == {"gateway", "order-svc", "bank-channel"}
    assert got["gateway"].affected_instances == 0 and got["gateway"].anomaly_count == 1  # the weakest node is no instance of it
    assert got["order-svc"].affected_instances == 1 and got["order-svc"].affected_ratio == 0.5
    assert got["bank-channel"].anomaly_count == 0 and got["bank-channel"].max_level is None
    assert RU.ordered(st).first().service == "gateway"
    grp = {r.grp: r for r in RU.group_stats(st).collect()}
    sets = RU.grouping_sets(st).collect()
    total = next(r for r in sets if r.grp is None)
    assert total.anomaly_count == sum(r.anomaly_count for r in grp.values()) == sum(r.anomaly_count for r in got.values()) == 3


def score(spark, *items, adjust=None):
    act = active(spark, *items) if items else active(spark, ("RES-01", "gateway", "gateway-0", "cpu_usage", 2)).where("false")
    parts = S.breakdown(act, runs(spark), POL)
    adj = None if adjust is None else literal_table(spark, [("run_id", "string"), ("adjust", "double")], [("r1", adjust)])
    return S.totals(parts, act, runs(spark), POL, adj).first(), parts.collect()


def test_clean_run_scores_100(spark):
    t, parts = score(spark)
    assert t.total == 100 and t.grade == "A" and len(parts) == 4 and all(p.deduction == 0 for p in parts)


def test_score_reconciles_and_caps(spark):
    t, parts = score(spark, ("RES-01", "bank-channel", "bank-channel-0", "cpu_usage", 1, 0, 99.0, 0.9))
    assert t.rule_score == pytest.approx(100 - sum(p.deduction for p in parts)) and t.cap == 60 and t.total == 60
    t, _ = score(spark, ("RES-01", "gateway", "gateway-0", "cpu_usage", 1), ("RES-02", "gateway", "gateway-0", "mem_usage", 1))
    assert t.cap == 45  # critical service beats the count of two


def test_adjustment_is_bounded(spark):
    item = ("RES-01", "bank-channel", "bank-channel-0", "cpu_usage", 3, 0, 90.0, 0.5)
    base, _ = score(spark, item)
    up, _ = score(spark, item, adjust=50.0)
    down, _ = score(spark, item, adjust=-50.0)
    assert (up.total, down.total) == (pytest.approx(min(100, base.total + 5)), pytest.approx(base.total - 5))


def test_graph_cycles_and_paths(spark):
    e = literal_table(spark, [("src", "string"), ("dst", "string")], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    c = {(r.src, r.dst): r for r in G.closure(e, with_paths=True).collect()}
    assert c[("a", "d")].hops == 3 and c[("a", "d")].path == ["a", "b", "c", "d"] and c[("a", "a")].hops == 3
    assert {tuple(r.path) for r in G.leaf_paths(e).where("head = 'a'").collect()} == {("a", "b", "c", "d")}
    comp = {r.node: r.component for r in G.components(e, literal_table(spark, [("node", "string")], [("lone",)])).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "lone": "lone"}
    hops = {r.node: r.hops for r in G.hop_distance(e, literal_table(spark, [("node", "string")], [("d",)])).collect()}
    assert hops == {"c": 1, "b": 2, "a": 3}
